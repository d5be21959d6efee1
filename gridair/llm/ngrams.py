"""Kneser-Ney trigrams over every word of trusted text: all orders' counts are tables dealt to shards by the hash of their key.

A word's id is a hash of its language and bytes, so no word table is needed and every word of trusted text is in the
model; words that it lacks share what the unigrams' discounts leave over, as one more word.  Texts lie in blocks.  A
block asks every shard for its different trigrams, pairs and words (a hot key once a block), the shards answer with
counts, and the block puts the orders together.  The driver gets a few numbers for each language.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridair.llm.common import written
from gridair.llm.words import words

#: Bytes of text in a block; tokens a shard is meant for; bits of a key; rows packed together.
BLOCK, SHARD, KEY, PACK = 8 << 20, 4_000_000, 56, 2_000_000
#: Kinds of keys that are asked for, and of the model's tables: (kind asked, kind of table) pairs are in ``TABLES``.
TRIGRAM, PAIR, WORD = 0, 1, 2
TABLES = {"trigram": TRIGRAM, "pair_before": PAIR, "pair": PAIR, "word_before": WORD, "word": WORD}


def tag_of(lang: str | None) -> str:
    return "-" if lang is None else "=" + lang


def word_id(tag: str, word: bytes | None) -> int:
    """63 bits; None is the start sign."""
    return int.from_bytes(blake2b(tag.encode() + (b"\x01" if word is None else b"\x00" + word), digest_size=8).digest(), "big") >> 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def keys(kind: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys (``KEY`` bits) of trigrams u v w, of pairs v w, or of words w."""
    full = pair_key(pair_key(u, v), w) if kind == TRIGRAM else pair_key(v, w) if kind == PAIR else _mixed(w.astype(np.uint64))
    return (full >> np.uint64(64 - KEY)).astype(np.int64)


def cuts(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin: shards are ranges of keys, which are evenly spread."""
    return np.searchsorted(sorted_keys, [(k << KEY) // shards for k in range(shards + 1)])


def _zip(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unzip(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _packed(x: np.ndarray) -> bytes:
    return _zip(np.diff(x, prepend=0))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data))


class _Ids(dict):
    """Numbers of a block's words of a language."""

    def __init__(self, tag: str, hashes: list[int]):
        self.tag, self.hashes = tag, hashes

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(word_id(self.tag, word))
        return n


ENCODED = "block long, doc_ids array<long>, langs array<string>, n_words array<long>, hashes binary, ids binary"


def encoded(rows: DataFrame) -> DataFrame:
    """Blocks of texts (doc_id, lang, text) as a written table: words are numbers into the block's list of ids."""
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        hashes, by_lang, docs, ids, held = [], {}, [], [], 0

        def flush():
            d, lang, n = (list(x) for x in zip(*docs, strict=True))
            cols = ((block, pa.int64()), (d, pa.list_(pa.int64())), (lang, pa.list_(pa.string())), (n, pa.list_(pa.int64())),
                    (_zip(np.array(hashes, np.int64)), pa.binary()), (_zip(np.concatenate(ids)), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cols], ["block", "doc_ids", "langs", "n_words", "hashes", "ids"])
        for batch in batches:
            for d, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                found = words(text)
                if lang not in by_lang:
                    by_lang[lang] = _Ids(tag_of(lang), hashes)
                ids.append(np.fromiter(map(by_lang[lang].__getitem__, found), np.uint32, len(found)))
                docs.append((d, lang, len(found)))
                held += len(text or b"") + 16
                if held > BLOCK:
                    yield flush()
                    block += 1
                    hashes, by_lang, docs, ids, held = [], {}, [], [], 0
        if docs:
            yield flush()
    return written(rows.select("doc_id", "lang", "text").mapInArrow(run, ENCODED), "encoded")


def trigrams(langs: list, n_words: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) of every word of a block's texts, the first two of a text with start signs, and the number of its text."""
    n = np.asarray(n_words, np.int64)
    of_lang = {lang: word_id(tag_of(lang), None) for lang in set(langs)}
    start = np.array([of_lang[x] for x in langs], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    first = (np.cumsum(n) - n)[n > 0]
    second = (np.cumsum(n) - n + 1)[n > 1]
    w = hashes[ids] if len(ids) else np.zeros(0, np.int64)
    v, u = np.roll(w, 1), np.roll(w, 2)
    v[first] = start[n > 0]
    u[first] = start[n > 0]
    u[second] = start[n > 1]
    return u, v, w, doc


def _merged(u, v, w, n):
    order = np.lexsort((w, v, u))
    u, v, w, n = u[order], v[order], w[order], n[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return u[at], v[at], w[at], np.add.reduceat(n, at) if len(at) else n


def trigram_counts(blocks: DataFrame, chosen: DataFrame, shards: int) -> DataFrame:
    """(tag, u, v, w, n, at_start) over the texts whose doc_id is in ``chosen`` (doc_id, different ones), a written table."""
    marks = (blocks.select("block", F.posexplode("doc_ids").alias("at", "doc_id")).join(chosen, "doc_id", "left_semi")
             .groupBy("block").agg(F.collect_list("at").alias("at")))  # as many as a block has texts

    def deal(batches):
        for batch in batches:
            for _, _, langs, n_words, hashes, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v, w, doc = trigrams(langs, n_words, _unzip(hashes), _unzip(ids, np.uint32))
                by_lang: dict = {}
                for k in at:
                    by_lang.setdefault(langs[k], []).append(k)
                for lang, texts in by_lang.items():
                    own = np.isin(doc, texts)
                    x = _merged(u[own], v[own], w[own], np.ones(int(own.sum()), np.int64))
                    to = np.searchsorted([(k << KEY) // shards for k in range(1, shards)], keys(TRIGRAM, *x[:3]), "right")
                    out = []
                    for k in np.unique(to):
                        mine = to == k
                        out.append((int(k), tag_of(lang), *(_zip(c[mine]) for c in x)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.string()] + [pa.binary()] * 4, strict=True)], ["shard", "tag", "u", "v", "w", "n"])

    def merge(frame):
        out = []
        for tag, own in frame.groupby("tag"):
            u, v, w, n = _merged(*(np.concatenate([_unzip(x) for x in own[c]]) for c in "uvwn"))
            out.append(pd.DataFrame({"tag": tag, "u": u, "v": v, "w": w, "n": n, "at_start": v == word_id(tag, None)}))
        return pd.concat(out)
    dealt = blocks.join(marks, "block").select("block", "doc_ids", "langs", "n_words", "hashes", "ids", "at").mapInArrow(deal, "shard int, tag string, u binary, v binary, w binary, n binary")
    return written(dealt.groupBy("shard").applyInPandas(merge, "tag string, u long, v long, w long, n long, at_start boolean"), "trigram-counts")


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """What to take off counts of 0, 1, 2 and more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    out = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5])
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """The tables of all orders (table, u, v, w, x, y) and each language's discounts.

    x and y by table: trigram count; pair_before tokens after the pair and what their discounts leave; pair number of
    different words before it (tokens at the start of a text); word_before sum of these and what discounts leave;
    word number of different words before it.
    """

    def __init__(self, counts: DataFrame):
        hist = lambda df: df.groupBy("tag", F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("times")).collect()  # noqa: E731 - five rows a language
        pairs = written(counts.groupBy("tag", "v", "w").agg(F.when(F.first("at_start"), F.sum("n")).otherwise(F.count(F.lit(1))).alias("n")), "pair-counts")
        ones = written(pairs.groupBy("tag", "w").agg(F.count(F.lit(1)).alias("n")), "word-counts")
        self.d = [self._discounts(hist(x)) for x in (counts, pairs, ones)]  # of trigrams, pairs, words
        self.rest = {}
        for r in ones.groupBy("tag").agg(F.sum("n").alias("every"), F.count(F.lit(1)).alias("many"), *[F.sum((F.least("n", F.lit(3)) == k).cast("long")).alias(f"k{k}") for k in (1, 2, 3)]).collect():
            off = sum(self.d[2][r.tag][k] * r[f"k{k}"] for k in (1, 2, 3))
            self.rest[r.tag] = (float(r.every), off / r.every / (r.many + 1))  # one more word: all that trusted text lacks
        left = lambda k: F.sum(self._off(k))
        none = F.lit(0).cast("long")
        select = lambda df, name, u, v, w, x, y: df.select(F.lit(name).alias("name"), u.alias("u"), v.alias("v"), w.alias("w"), x.cast("long").alias("x"), y.cast("double").alias("y"))
        zero = F.lit(0.0)
        before = counts.groupBy("tag", "u", "v").agg(F.sum("n").alias("x"), left(0).alias("y"))
        word_before = pairs.groupBy("tag", "v").agg(F.sum("n").alias("x"), left(1).alias("y"))
        c = F.col
        self.tables = (select(counts, "trigram", c("u"), c("v"), c("w"), c("n"), zero)
                       .unionAll(select(before, "pair_before", none, c("u"), c("v"), c("x"), c("y")))
                       .unionAll(select(pairs, "pair", none, c("v"), c("w"), c("n"), zero))
                       .unionAll(select(word_before, "word_before", none, none, c("v"), c("x"), c("y")))
                       .unionAll(select(ones, "word", none, none, c("w"), c("n"), zero)))

    @staticmethod
    def _discounts(rows) -> dict[str, np.ndarray]:
        by: dict = {}
        for r in rows:
            by.setdefault(r.tag, {})[r.k] = r.times
        return {tag: discounts(x) for tag, x in by.items()}

    def _off(self, order: int) -> F.Column:
        """The discount of the count ``n`` of a row."""
        out = F.lit(0.0)
        for tag, d in self.d[order].items():
            for k in (1, 2, 3):
                out = F.when((F.col("tag") == tag) & (F.least("n", F.lit(3)) == k), float(d[k])).otherwise(out)
        return out

    def combine(self, tags: np.ndarray, tri: np.ndarray, before: tuple, pair: np.ndarray, word_before: tuple, word: np.ndarray) -> np.ndarray:
        """Log-probabilities from the counts of the orders; ``tags`` are the texts' languages, all in the model."""
        names, lang = np.unique(tags, return_inverse=True)
        d3, d2, d1 = (np.array([d[x] for x in names]).reshape(-1, 4) for d in self.d)
        every, rest = np.array([self.rest[x] for x in names]).reshape(-1, 2).T
        less = lambda d, n: np.maximum(n - d[lang, np.minimum(n, 3)], 0)
        p1 = less(d1, word) / every[lang] + rest[lang]
        total, off = word_before
        p2 = np.where(total > 0, (less(d2, pair) + off * p1) / np.maximum(total, 1), p1)
        total, off = before
        return np.log(np.where(total > 0, (less(d3, tri) + off * p2) / np.maximum(total, 1), p2))


def dealt(tables: DataFrame, shards: int) -> DataFrame:
    """(shard, name, keys, x, y): the rows of the model packed for their shards."""
    def run(batches):
        held: dict = {}

        def flush(name):
            key, x, y = (np.concatenate(c) for c in zip(*held.pop(name), strict=True))
            order = np.argsort(key)
            key, x, y = key[order], x[order], y[order]
            at = cuts(key, shards)
            out = [(k, name, _packed(key[i:j]), _zip(x[i:j]), _zip(y[i:j])) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.string()] + [pa.binary()] * 3, strict=True)], ["shard", "name", "keys", "x", "y"])
        for batch in batches:
            name = np.array(batch.column(0).to_pylist())
            u, v, w, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            for one in np.unique(name):
                own = name == one
                held.setdefault(str(one), []).append((keys(TABLES[str(one)], u[own], v[own], w[own]), x[own], y[own]))
                if sum(len(c[0]) for c in held[str(one)]) > PACK:
                    yield flush(str(one))
        for one in list(held):
            yield flush(one)
    return tables.mapInArrow(run, "shard int, name string, keys binary, x binary, y binary")


def _asked(u, v, w) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each kind the different keys and where each use finds its own."""
    out = []
    for sets in ((keys(TRIGRAM, u, v, w),), (keys(PAIR, u, u, v), keys(PAIR, u, v, w)), (keys(WORD, u, v, v), keys(WORD, u, v, w))):
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        out.append((every, np.split(at, len(sets))))
    return out


def scored(blocks: DataFrame, model: Model, shards: int) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity) of all texts, a written table; null without words or trusted text of the language."""
    in_model = set(model.rest)

    def judged(langs, n_words, hashes, ids):
        u, v, w, doc = trigrams(langs, n_words, _unzip(hashes), _unzip(ids, np.uint32))
        known = np.array([tag_of(x) in in_model for x in langs], bool)[doc]
        return u[known], v[known], w[known], doc[known]

    def ask(batches):
        for batch in batches:
            for block, langs, n_words, hashes, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v, w, _ = judged(langs, n_words, hashes, ids)
                if not len(u):
                    continue
                every = [x for x, _ in _asked(u, v, w)]
                at = [cuts(x, shards) for x in every]
                out = [(block, k, *(_packed(x[a[k]:a[k + 1]]) for x, a in zip(every, at, strict=True))) for k in range(shards)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32()] + [pa.binary()] * 3, strict=True)], ["block", "shard", "k0", "k1", "k2"])

    def answer(known, asked):
        table = {}
        for name in TABLES:
            own = known[known["name"] == name]
            if len(own):
                key = np.concatenate([_unpacked(x) for x in own["keys"]])
                order = np.argsort(key)
                table[name] = key[order], np.concatenate([_unzip(x) for x in own["x"]])[order], np.concatenate([_unzip(x, np.float64) for x in own["y"]])[order]
        out = {f"{name}_{c}": [] for name in TABLES for c in "xy"}
        for row in zip(asked["k0"], asked["k1"], asked["k2"], strict=True):
            wanted = [_unpacked(x) for x in row]
            for name, kind in TABLES.items():
                k = wanted[kind]
                x, y = np.zeros(len(k), np.int64), np.zeros(len(k))
                if name in table and len(k):
                    key, have_x, have_y = table[name]
                    at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                    hit = key[at] == k
                    x[hit], y[hit] = have_x[at[hit]], have_y[at[hit]]
                out[f"{name}_x"].append(_zip(x))
                out[f"{name}_y"].append(_zip(y) if name.endswith("before") else b"")
        return pd.DataFrame({"block": asked["block"].to_numpy(), "shard": asked["shard"].to_numpy(), **out})

    def finish(rows, answers):
        row = rows.iloc[0]
        langs, n_words = list(row["langs"]), np.asarray(row["n_words"], np.int64)
        mean = np.full(len(langs), np.nan)
        if len(answers):
            u, v, w, doc = judged(langs, n_words, row["hashes"], row["ids"])
            answers = answers.sort_values("shard")
            (_, (t,)), (_, (uv, vw)), (_, (of_v, of_w)) = _asked(u, v, w)
            x = {name: np.concatenate([_unzip(b) for b in answers[f"{name}_x"]]) for name in TABLES}
            y = {name: np.concatenate([_unzip(b, np.float64) for b in answers[f"{name}_y"]]) for name in TABLES if name.endswith("before")}
            tags = np.array([tag_of(x) for x in langs])
            logs = model_combine(tags[doc], x["trigram"][t], (x["pair_before"][uv], y["pair_before"][uv]), x["pair"][vw], (x["word_before"][of_v], y["word_before"][of_v]), x["word"][of_w])
            n = np.bincount(doc, minlength=len(langs))
            mean[n > 0] = -(np.bincount(doc, weights=logs, minlength=len(langs))[n > 0] / n[n > 0])
        ids = [None if d is None or d != d else int(d) for d in row["doc_ids"]]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "lang": langs, "n_words": n_words, "log_perplexity": pd.array([None if m != m else m for m in mean], "Float64")})

    light = Model.__new__(Model)  # without the tables, which stay on the driver
    light.d, light.rest = model.d, model.rest
    model_combine = light.combine
    requests = blocks.select("block", "langs", "n_words", "hashes", "ids").mapInArrow(ask, "block long, shard int, k0 binary, k1 binary, k2 binary")
    reply = "block long, shard int, " + ", ".join(f"{name}_{c} binary" for name in TABLES for c in "xy")
    answers = dealt(model.tables, shards).groupBy("shard").cogroup(requests.groupBy("shard")).applyInPandas(answer, reply)
    # Ids as text: pandas would make them floats where one is null.
    return written(blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "doc_id long, lang string, n_words long, log_perplexity double"), "scored")
