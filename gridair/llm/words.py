"""Words of texts, and the most frequent ones of each language, counted exactly."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm.common import written

#: Different words that a task holds before it reports a part of its rows.
HELD = 500_000


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and the control characters 9 to 13."""
    return (text or b"").split()


def common_words(rows: DataFrame, top: int, share: float, least: int = 1) -> tuple[dict[str | None, dict[bytes, int]], dict[str | None, int]]:
    """Counts of the ``top`` most frequent words of each lang of ``rows`` (lang, text), of equal counts the smaller bytes, and of all words of the lang.

    Texts of fewer than ``least`` words don't count.  Only langs with at least ``share`` of all words are given, so
    there are top / share words at most, whatever the corpus.  Tasks add up what they see before anything is shuffled;
    each partition keeps its own first ``top`` of a lang before they are ranked together.
    """
    def count(batches):
        held, totals = defaultdict(Counter), Counter()

        def flush():
            out = [(lang, w, c) for lang, counts in held.items() for w, c in counts.items()] + [(lang, None, c) for lang, c in totals.items()]
            held.clear()
            totals.clear()
            cols = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                found = words(text)
                if len(found) >= max(1, least):
                    held[lang].update(found)
                    totals[lang] += len(found)
            if sum(map(len, held.values())) > HELD:
                yield flush()
        yield flush()

    told = rows.select("lang", "text").mapInArrow(count, "lang string, word binary, n long")
    summed = written(told.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = summed.where("word is null")
    every = totals.agg(F.sum("n")).first()[0] or 0
    totals = {r.lang: r.n for r in totals.where(F.col("n") >= share * every).collect()}  # 1 / share at most
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = summed.where("word is not null").withColumn("place", place).where(F.col("place") <= top)
    large = summed.where(F.col("word").isNull() & (F.col("n") >= share * every)).select(F.col("lang").alias("named"))
    found: dict = defaultdict(dict)
    for r in first.join(large, F.col("lang").eqNullSafe(F.col("named")), "left_semi").collect():  # top / share at most
        found[r.lang][bytes(r.word)] = r.n
    return dict(found), totals
