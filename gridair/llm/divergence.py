"""Quality rules by distribution divergence (operator 2).

Every document has a histogram of character classes and one of its language's common words (all others in one bin).
Both are compared with the same histograms of the language's whole corpus by Jensen-Shannon distance (base 2, square
root).  A distance counts only where the document has enough characters or words for it to mean something.  The limit
of the word distance is a language's own: a share of the distance that a text without any common word has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridair.llm.words import common_words, words

#: Common words of a language, by rank; a language has a reference if it makes at least this share of all words of the corpus.
TOP, SHARE = 32, 0.0005
#: Largest distances that pass: of character classes, and of words as a share of the distance of a text without a common word.
CHAR_LIMIT, WORD_LIMIT = 0.28, 0.95
#: Least characters and words for either to be judged; least share of a language's words that its common ones make.
CHAR_LEAST, WORD_LEAST, COVER = 200, 50, 0.1
#: Documents of fewer words give nothing to the references and fail at once.
LEAST = 50

# Classes of ASCII characters; all other ASCII characters are class 5, all beyond ASCII class 6.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:'\"!?()-")
SYMBOLS = "#*$%&|<>"
N_CLASSES = 7


def _class_table() -> np.ndarray:
    table = np.full(256, 5)
    for k, chars in enumerate(CLASSES):
        table[list(chars.encode())] = k
    table[192:] = 6  # one leading byte for each character beyond ASCII
    table[128:192] = N_CLASSES  # the others of its bytes: left out
    return table


_TABLE = _class_table()


def char_classes(bytes_seen: np.ndarray) -> np.ndarray:
    """Characters in each class, from how often each byte value occurs."""
    return np.bincount(_TABLE, weights=bytes_seen, minlength=N_CLASSES + 1)[:N_CLASSES].astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    gain = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return max(0.0, gain / 2) ** 0.5


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a window of three words that occurs at least twice."""
    n = len(found)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in found], np.int64)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, triple, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[triple] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= twice
    return int(inside.sum())


def base(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the character classes and the words of a text."""
    text = text or b""
    found = words(text)
    bytes_seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = char_classes(bytes_seen)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return (len(found), int(classes.sum() - classes[3]), int(bytes_seen[list(SYMBOLS.encode())].sum()), len(lines) - len(set(lines)), repeated_words(found)), classes, found


def references(rows: DataFrame, top: int = TOP, share: float = SHARE) -> dict:
    """{lang: (class counts, {word: bin}, word counts with the rest at the end, distance of a text without a common word)} over all ``rows`` (lang, text) of enough words.

    Only languages with ``share`` of all words have a reference, so its size is bounded by top / share entries.  The
    last is None where common words make less than ``COVER`` of the language: there words tell nothing.
    """
    found, totals = common_words(rows, top, share, LEAST)

    def classes(batches):
        sums: dict = {lang: np.zeros(256, np.int64) for lang in found}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if lang in sums and text is not None and len(words(text)) >= LEAST:
                    sums[lang] += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([char_classes(s).tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "n"])

    per_task = rows.select("lang", "text").mapInArrow(classes, "lang string, n array<long>")
    by_class = per_task.groupBy("lang").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(N_CLASSES)]).alias("n")).collect()
    out = {}
    for r in by_class:
        order = sorted(found[r.lang])
        counts = np.array([found[r.lang][w] for w in order], np.int64)
        counts = np.append(counts, totals[r.lang] - counts.sum())
        without = distance(np.arange(len(counts)) == len(order), counts) if counts[:-1].sum() >= COVER * counts.sum() else None
        out[r.lang] = (np.array(r.n, np.int64), {w: i for i, w in enumerate(order)}, counts, without)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: tuple[float, float] = (CHAR_LIMIT, WORD_LIMIT),
          carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept (and the columns named in ``carry``).

    A null or empty text has no words and fails.  Null ids stay null.  A null language is a language of its own; one
    without a reference (under ``SHARE`` of all words) is judged by the base rules alone, its distances are null, as are
    those of texts under the least length; where common words make less than ``COVER`` of a language (as where words are
    not parted by spaces) the word distance is null.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    refs = references(rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in carry])
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                facts, classes, found = base(text)
                n, rep = facts[0], facts[4]
                failed = n < LEAST or 100 * rep > 50 * n
                char_d = word_d = without = None
                if lang in refs and n:
                    ref_classes, bins, ref_words, without = refs[lang]
                    if classes.sum() >= CHAR_LEAST:
                        char_d = distance(classes, ref_classes)
                    if n >= WORD_LEAST and without is not None:
                        rest = len(bins)
                        at = np.array([bins.get(w, rest) for w in found], np.int64)
                        word_d = distance(np.bincount(at, minlength=rest + 1), ref_words)
                kept = not failed and (char_d or 0) <= limits[0] and (word_d is None or word_d <= limits[1] * without)
                out.append((*facts, failed, char_d, word_d, kept))
            cols = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True)), *batch.columns[3:]], [*names, *carry])

    tail = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
                                  "char_distance double, word_distance double, kept boolean" + tail)
