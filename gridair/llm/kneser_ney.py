"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text (operator 6).

Every word of trusted text is in the model, whose tables of all orders are dealt to shards (``ngrams``).  A document
passes if its perplexity is no higher than a quantile of its language's trusted documents that were held out of the
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair.llm import ngrams

#: Quantile of the trusted documents' perplexity that still passes; least words to be judged.
QUANTILE, LEAST = 0.99, 20
#: One in so many trusted documents is held out of the counts; the quantiles are theirs.
HELD_OUT = 5
#: Short texts scatter more: each language has a quantile for each of the lengths parted by these numbers of words.
BANDS = (64, 256)
#: A length with fewer held-out texts is judged by the quantile of all lengths of its language.
FEW = 20
#: Bins of log perplexity for each unit.
BINS = 1000


def limits(judged: DataFrame, quantile: float) -> DataFrame:
    """(lang, band, limit): the upper ends of the bins that hold the quantiles of ``judged`` (lang, band, log_perplexity); band -1 is all lengths.

    Counts in narrow bins: as many rows as bins, and the same however the rows are dealt out.
    """
    bins = judged.groupBy("lang", "band", F.ceil(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    both = bins.unionByName(bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")).withColumn("band", F.lit(-1)))
    own = Window.partitionBy("lang", "band")
    ranked = both.select("lang", "band", "bin", F.sum("n").over(own.orderBy("bin")).alias("past"), F.sum("n").over(own).alias("every"))
    enough = (F.col("band") < 0) | (F.col("every") >= FEW)
    return ranked.where(enough & (F.col("past") >= quantile * F.col("every"))).groupBy("lang", "band").agg((F.min("bin") / BINS).alias("limit"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, kept) for every row of ``docs``; ``trusted`` (doc_id) names the text to learn from.

    Documents of fewer than ``LEAST`` words and those of a language without trusted text or without a held-out one of
    ``LEAST`` words are kept unjudged; a length with fewer than ``FEW`` held-out texts takes the limit of all lengths of
    its language; a text without words or without trusted text of its language has a null perplexity.  Null ids stay null; a null language is
    a language of its own; repeated rows count and come out as often as they are.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = ngrams.encoded(rows)
    good = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0  # texts that were counted would look better than others
    tokens = blocks.agg(F.sum(F.expr("aggregate(n_words, 0L, (a, n) -> a + n)"))).first()[0] or 0
    shards = max(1, -(-tokens // ngrams.SHARD))
    counts = ngrams.trigram_counts(blocks, good.where(~held_out), shards)
    table = ngrams.scored(blocks, ngrams.Model(counts), shards)
    band = sum((F.when(F.col("n_words") >= n, 1).otherwise(0) for n in BANDS), F.lit(0))
    table = table.withColumn("band", band)
    judged = table.where(F.col("log_perplexity").isNotNull() & (F.col("n_words") >= LEAST)).join(good.where(held_out), "doc_id", "left_semi")
    found = limits(judged, quantile)
    by_band = found.where("band >= 0").select(F.col("lang").alias("own_lang"), F.col("band").alias("own_band"), F.col("limit").alias("own"))
    by_lang = found.where("band < 0").select(F.col("lang").alias("any_lang"), F.col("limit").alias("any"))
    table = table.join(by_band, F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("band") == F.col("own_band")), "left").join(by_lang, F.col("lang").eqNullSafe(F.col("any_lang")), "left")
    kept = F.coalesce(F.col("log_perplexity") <= F.coalesce("own", "any"), F.lit(True)) | (F.col("n_words") < LEAST)
    return table.select("doc_id", "lang", "n_words", F.exp("log_perplexity").alias("perplexity"), kept.alias("kept"))
