"""The classifier's model over all words beside a plain computation, and what only rare words can tell."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridair.llm import kneser_ney, ngrams

rnd = random.Random(11)


def plain(counted, text):
    """Log perplexity of ``text`` by dictionaries of counts."""
    def grams(t):
        x = ["<s>", "<s>", *t.split()]
        return list(zip(x, x[1:], x[2:]))
    c3 = Counter(g for t in counted for g in grams(t))
    n2, n1 = Counter(), Counter()
    for (_, v, w), n in c3.items():
        n2[v, w] += n if v == "<s>" else 1
    for _, w in n2:
        n1[w] += 1
    d = [ngrams.discounts(Counter(min(n, 5) for n in c.values())) for c in (c3, n2, n1)]

    def of(counts, d, prefix):
        own = [n for k, n in counts.items() if prefix(k)]
        return sum(own), sum(d[min(n, 3)] for n in own)
    every, off = of(n1, d[2], lambda k: True)
    out = 0
    for u, v, w in grams(text):
        p = max(n1[w] - d[2][min(n1[w], 3)], 0) / every + off / every / (len(n1) + 1)
        for counts, dd, key, prefix in ((n2, d[1], (v, w), lambda k: k[0] == v), (c3, d[0], (u, v, w), lambda k: k[:2] == (u, v))):
            total, left = of(counts, dd, prefix)
            if total:
                p = (max(counts[key] - dd[min(counts[key], 3)], 0) + left * p) / total
        out -= math.log(p)
    return out / len(text.split())


def test_all_words_beside_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD", 500)  # several shards
    names = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(names, weights=[1 / (k + 1) for k in range(60)], k=rnd.randint(1, 60))), rnd.choice(["en", None])) for i in range(60)]
    docs += [(100, "w1 never w2 seen", "en"), (101, "", "en"), (102, "bonjour", "fr"), (None, "w1 w2 w3", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    held = {r.doc_id for r in good.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    got = kneser_ney.classify(df, good).collect()
    assert len(got) == len(docs)
    by = defaultdict(list)
    for i, t, lang in docs:
        if i is not None and i < 40 and i not in held:
            by[lang].append(t)
    want = {i: (plain(by[lang], t) if lang in by and t else None) for i, t, lang in docs}
    for r in got:
        if want[r.doc_id] is None:
            assert r.perplexity is None and r.kept
        else:
            assert math.isclose(math.log(r.perplexity), want[r.doc_id], rel_tol=1e-9)


def test_rare_words_in_wrong_order_fail(spark):
    """No word makes 0.1 % of the corpus: only a model of rare words tells a phrase from its shuffled words."""
    phrases = [[f"p{i}x{k}" for k in range(10)] for i in range(150)]
    docs = [(i, " ".join(w for p in rnd.choices(phrases, k=12) for w in p), "en") for i in range(400)]
    for i in range(5):
        salad = [w for p in rnd.choices(phrases, k=12) for w in p]
        rnd.shuffle(salad)
        docs.append((1000 + i, " ".join(salad), "en"))
    got = kneser_ney.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in range(400)], "doc_id long")).collect()
    assert all(not r.kept for r in got if r.doc_id >= 1000)
    assert sum(not r.kept for r in got if r.doc_id < 1000) <= 12


def test_probabilities_after_any_context_sum_to_one(spark):
    names = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, lang, " ".join(rnd.choices(names, weights=range(30, 0, -1), k=rnd.randint(5, 60)))) for i in range(40) for lang in ("en", None)], "doc_id long, lang string, text string")
    model = ngrams.Model(ngrams.trigram_counts(ngrams.encoded(docs), spark.range(40).select(F.col("id").alias("doc_id")), 3))
    of = defaultdict(dict)
    for r in model.tables.collect():
        key = {"trigram": (r.u, r.v, r.w), "pair_before": (r.v, r.w), "pair": (r.v, r.w)}.get(r.name, r.w)
        of[r.name][key] = (r.x, r.y)
    for lang in ("en", None):
        tag = ngrams.tag_of(lang)
        start, ids = ngrams.word_id(tag, None), [ngrams.word_id(tag, w.encode()) for w in names]
        every = [*[x for x in ids if x in of["word"]], -1]  # -1: all that trusted text lacks
        for u, v in ((start, start), (start, ids[2]), (ids[2], ids[4]), (ids[0], ids[0]), (ids[1], -5), (-5, ids[1])):
            some = lambda name, keys: np.array([of[name].get(k, (0, 0.0)) for k in keys])
            n = lambda name, keys: some(name, keys)[:, 0].astype(np.int64)
            before, word_before = some("pair_before", [(u, v)] * len(every)), some("word_before", [v] * len(every))
            logs = model.combine(np.array([tag] * len(every)), n("trigram", [(u, v, w) for w in every]), tuple(before.T), n("pair", [(v, w) for w in every]), tuple(word_before.T), n("word", every))
            assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-9)


def test_limits_beside_sorted_values(spark):
    rows = [(lang, rnd.randint(0, 2) if lang != "few" else 0, rnd.random() * 9) for lang in ["en"] * 300 + [None] * 50 + ["few"] * 4]
    rows += [("en", 3, 5.0)] * 3  # a length with few texts has no limit of its own
    got = {(r.lang, r.band): r.limit for r in kneser_ney.limits(spark.createDataFrame(rows, "lang string, band int, log_perplexity double").repartition(4), 0.9).collect()}
    groups = defaultdict(list)
    for lang, band, x in rows:
        groups[lang, band].append(x)
        groups[lang, -1].append(x)
    want = {}
    for (lang, band), own in groups.items():
        if band < 0 or len(own) >= kneser_ney.FEW:
            want[lang, band] = math.ceil(sorted(own)[math.ceil(0.9 * len(own)) - 1] * kneser_ney.BINS) / kneser_ney.BINS
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
