"""Whole texts to token ids with the ``tokenizers`` library, each different word encoded once a worker.

Both vocabularies split a text into words before they merge, and never across the borders used here, so a text's ids
are the ids of its units in order.  A worker keeps the units it has seen (a bounded cache) as bytes, and a text is the
join of its units' bytes.  A unit of letters only is one word for the vocabulary's model; any other unit goes through
the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Units kept by a worker before it starts anew.
CACHE = 900_000

# White space by Unicode and the endings that both vocabularies split off.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDING = "'(?:[stmd]|re|ve|ll)"
_SPACED = re.compile(f"{_ENDING}| ?[^\\W_]+| ?(?:[^{_SPACE}\\w]|_)+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")
_BARE = re.compile(f"{_ENDING}|[^\\W_]+|(?:[^{_SPACE}\\w]|_)+")
_LOADED: dict[str, Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one after 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """``encode(texts)`` gives every text's ids as bytes, ``width`` little-endian bytes an id.  The entries are the cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # this cache serves instead
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.lower = self.tokenizer.normalizer is not None  # normal form C, lower case, white space dropped
        self.letters = _byte_letters()

    def __missing__(self, unit: str) -> bytes:
        bare = unit if self.lower else unit.removeprefix(" ")
        if bare.isalpha() and (bare.isascii() or not self.lower or bare == bare.lower()):
            ids = [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        out = self[unit] = np.array(ids, f"<u{self.width}").tobytes()
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self) > CACHE:
            self.clear()
        get, split = self.__getitem__, (_BARE if self.lower else _SPACED).findall
        return [b"".join(map(get, split(self._plain(t or b"")))) for t in texts]

    def _plain(self, text: bytes) -> str:
        if not self.lower:
            return text.decode()
        text = text.lower().decode()  # A-Z only; the tokenizer lowers the rest, letter by letter
        if text.isascii():
            return text
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("\u0130", "i\u0307")  # the only letter that lower case makes two characters of


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def slices(texts: list[bytes | None], size: int = 4 << 20):
    """Ranges of a batch whose texts have about ``size`` bytes together, so that only these are held as ids."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
