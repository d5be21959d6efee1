"""Budgets of corpora whose token counts are beyond what the driver's tables hold here."""

from gridair.llm import budget_tree


def test_budgets_of_a_very_large_corpus(spark):
    leaves = [("a", "en", "s1", 10 ** 15), ("a", "en", "s2", 7 * 10 ** 14 + 1), ("a", "de", "s3", 3), ("b", "en", "s4", 5 * 10 ** 14)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"a": 3}, "lang": {"en": 6}}
    got = {r.source: r.got for r in budget_tree.budgets(df, ["domain", "lang", "source"], weights, (3, 4), 2).collect()}
    total = sum(n for *_, n in leaves)
    budget = total * 3 // 4
    assert sum(got.values()) == budget and all(0 <= got[s] <= 2 * n for *_, s, n in leaves)
    # Weights 3 and 1: domain b's quarter fits in its two epochs; the six tokens of German leave the rest of domain a to English, halved.
    assert got["s4"] == budget - budget * 3 // 4 or abs(got["s4"] - budget // 4) <= 1
    assert got["s3"] == 6 and abs(got["s1"] - got["s2"]) <= 1
