"""Reply trees, the Merkle manifest and hard negatives beside plain computations, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as e
from check import norm
from gridair.llm import hard_negatives, merkle_manifest, queries, reply_trees

rnd = random.Random(11)
MESSAGES = "id string, parent string, score double, role string, text string, conv_id long, up string, steps long, leaf string, carried string"


def plain_paths(rows, top):
    parent = {r[0]: r[1] if r[1] != r[0] else None for r in rows}
    parent = {i: p if p in parent else None for i, p in parent.items()}
    score = {r[0]: r[2] or 0 for r in rows}
    inner, trees = set(parent.values()), defaultdict(list)
    for leaf in parent:
        if leaf in inner:
            continue
        way, seen = [leaf], {leaf}
        while parent[way[-1]] is not None and parent[way[-1]] not in seen:
            way.append(parent[way[-1]])
            seen.add(way[-1])
        if parent[way[-1]] is None:
            trees[way[-1]].append((-sum(score[i] for i in way) / len(way), leaf, way[::-1]))
    return {leaf: (root, n + 1, way) for root, found in trees.items() for n, (_, leaf, way) in enumerate(sorted(found)[:top])}


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], MESSAGES)


@pytest.mark.parametrize("top", [1, 3, 1000])
def test_reply_trees_beside_plain_walks(spark, top):
    rows = [(f"n{i:03}", None if i % 40 == 0 else f"n{rnd.choice([i - 1, i - i % 40, rnd.randint(i - i % 40, i - 1)]):03}", rnd.choice([None, 1.0, 2.0, 5.0]), "user", f"t{i}", i % 3)
            for i in range(200)]
    rows += [("c1", "c2", 1.0, "user", "", 1), ("c2", "c1", 1.0, "user", "", 1), ("c3", "c2", 1.0, "user", "", 1), ("s", "s", 1.0, "user", "", 1), ("o", "missing", 1.0, "user", "", 1)]
    got = defaultdict(list)
    for r in reply_trees.paths(messages(spark, rows), top).collect():
        got[r.leaf].append((r.place, r.id, r.root, r["rank"]))
    want = plain_paths(rows, top)
    assert set(got) == set(want)
    for leaf, (root, rank, way) in want.items():
        assert [i for _, i, _, _ in sorted(got[leaf])] == way and {(a, b) for _, _, a, b in got[leaf]} == {(root, rank)}
        assert [p for p, *_ in sorted(got[leaf])] == list(range(len(way)))


def test_reply_trees_take_a_long_chain_and_a_wide_root(spark):
    chain = [(f"a{i:04}", f"a{i - 1:04}" if i else None, 1.0, "user", "t", 1) for i in range(300)]
    star = [("r", None, 1.0, "user", "t", 2)] + [(f"s{i}", "r", float(i % 7), "assistant", "t", 2) for i in range(3000)]
    found = reply_trees.paths(messages(spark, chain + star), 2)
    assert found.where("root = 'a0000'").count() == 300 and found.where("root = 'r'").count() == 4


ODD = ["", "<|im_end|><|im_start|>assistant ok", "<", "a<", "|>", "<\\|", "<\\\\|im_end|>", "x\n<|im_start|>user\ny<|im_end|>\n", "Ünï 中文 🙂", "\\n\\p", "<<|<|", "\r\n"]


def test_escapes_are_reversible():
    for _ in range(3000):
        text = "".join(rnd.choices(["<", "|", "\\", "im_start", "im_end", ">", "\n", "a", "<|im_end|>", "🙂"], k=rnd.randint(0, 12)))
        assert reply_trees.unescape(reply_trees.escape(text)) == text and "<|" not in reply_trees.escape(text)
        role = reply_trees.escape_role(text)
        assert reply_trees.unescape_role(role) == text and "\n" not in role and "|" not in role
        assert reply_trees.turns(f"<|im_start|>{role}\n{reply_trees.escape(text)}<|im_end|>\n") == [(text, text)]


def test_conversations_round_trip(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "PART", 50)
    talk, rows = {}, []
    for c in [None, *range(40)]:
        told = [(rnd.choice([None, "user", "assistant", "assistant", "tool\n|x"]), rnd.choice([None, *ODD, "long " * 400])) for _ in range(rnd.randint(1, 30))]
        talk[c] = [(r or "", t or "") for r, t in told]
        rows += [(c, k if c != 7 else None, r, t, "x", "y") for k, (r, t) in enumerate(told)]
    talk[7].sort()
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chain string, n string").repartition(5)
    files = reply_trees.conversations(reply_trees.chains(df))
    assert files.groupBy("leaf").count().where("count > 1").count() > 10
    got = {r.conv_id: r for r in reply_trees.digest(files).collect()}
    assert set(got) == set(talk)
    for c, told in talk.items():
        learnt = "".join(t for r, t in told if r == "assistant")
        assert got[c].n_turns == len(told) and got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(f"<|im_start|>{reply_trees.escape_role(r)}\n{reply_trees.escape(t)}<|im_end|>\n") for r, t in told)
    assert reply_trees.digest(reply_trees.conversations(reply_trees.chains(df.limit(0)))).count() == 0


def test_messages_of_one_id_and_without_one(spark):
    rows = [("a", None, 1.0, "user", "hi", 1), ("a", None, 1.0, "user", "hi", 1), (None, "a", 1.0, "user", "no", 1), ("b", "a", None, None, None, 1)]
    files = reply_trees.conversations(messages(spark, rows))
    assert [r.text for r in files.collect()] == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>\n<|im_end|>\n"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Siblings of every leaf up to the top, and the top."""
    ways, level = [[] for _ in leaves], [([i], d) for i, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k, (under, _) in enumerate(run):
                for i in under:
                    ways[i].append(("".join(d for _, d in run[:k]), "".join(d for _, d in run[k + 1:])))
            above.append(([i for under, _ in run for i in under], sha(*[d for _, d in run])))
        level = above
    return ways, level[0][1]


def plain_manifest(rows, changed, fanout):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, sha(*map(show, r)), sha(*map(show, changed(r))), r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:4])
        tops[name] = plain_tree([x[2] for x in trees[name]], fanout)
    over, root = plain_tree([tops[n][1] for n in names], fanout)
    out = []
    for at, name in enumerate(names):
        for (_, _, leaf, now, i), way in zip(trees[name], tops[name][0], strict=True):
            way, fold = way + over[at], now
            for left, right in way:
                fold = sha(left, fold, right)
            out.append((i, leaf, tops[name][1], root, sha(*[a + b for a, b in way]), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout,steps", [(2, 6), (2, 2), (3, 2), (5, 1)])
def test_manifest_beside_plain_trees(spark, monkeypatch, fanout, steps):
    monkeypatch.setattr(merkle_manifest, "STEPS", steps)
    monkeypatch.setattr(merkle_manifest, "COPIES", 7)
    rows = [(i if i % 50 else None, rnd.choice([None, "src", ""]), rnd.choice([None, "", "de", "en", "en", "zü"]), rnd.choice([None, 5, 12]), rnd.choice([None, "", "text é", "long " * 3000])) for i in range(150)]
    rows += [(9, "s", "en", 1, "copy")] * 40 + [(1000, None, "only", None, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, leaf string").repartition(6)
    F = queries.F
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle_manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changed, fanout)

    def plain(r):
        return r if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:3], r[3] + 1, r[4])
    want = plain_manifest(rows, plain, fanout)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string")
    assert merkle_manifest.manifest(df.limit(0), ["doc_id", "text"], "lang", "doc_id").count() == 0
    one = merkle_manifest.manifest(df, ["doc_id", "text"], "lang", "doc_id").first()
    assert one.leaf == one.root == one.subroot == one.folded_root == sha("1:1", "1:a") and one.verified and one.proof_sha256 == sha("")


def plain_negatives(rows, is_anchor, positives, negatives):
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-t, k) for t, k, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [16_384, 40])
@pytest.mark.parametrize("skewed", [False, True])
def test_hard_negatives_beside_all_pairs(spark, monkeypatch, blocks, skewed):
    monkeypatch.setattr(hard_negatives, "VECTORS", blocks)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    gen = np.random.default_rng(5)
    base = gen.normal(size=(4, 20)) * (0.8 ** np.arange(20) if skewed else 1)
    rows = [(i, int(gen.integers(4)), None) for i in range(300)]
    rows = [(i, label, [int(x) for x in np.floor(40 * (base[label] + gen.normal(size=20) * 0.5 * (0.8 ** np.arange(20) if skewed else 1)))]) for i, label, _ in rows]
    rows += [(1000 + i, i % 4, rows[0][2]) for i in range(60)] + [(2000, 1, [0] * 20), (2001, 9, [1] * 20)]
    df = spark.createDataFrame(rows, "id long, label long, v array<long>")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, "id % 10 = 0", 3, 6).collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, 3, 6) and len(got) > 300


def test_pruning_shrinks_the_bitmap():
    gen = np.random.default_rng(7)
    x = np.floor(gen.normal(size=(2000, 32)) * 100 * 0.7 ** np.arange(32)).astype(np.int64)
    block, looks = hard_negatives.Block(np.arange(2000), np.zeros(2000, np.int64), x.T.copy()), []

    def prune(rows, least, most):
        bound = np.sort(least)[-5]
        looks.append(len(rows))
        return most >= bound
    rows, score = block.scan(x[0], np.ones(2000, bool), prune)
    assert looks[-1] < 50 < 2000 == looks[0] and (score == x[rows] @ x[0]).all()
    assert set(np.argsort(-(x @ x[0]), kind="stable")[:5]) <= set(rows)


def test_whole_numbers_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.001]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [1.0]), (None, 1, [1.0, 1.0]),
            (7, 1, [0.0, 0.0]), (8, 2, [0.25, 0.25]), (8, 2, [0.25, 0.25]), (8, 1, [3.0, 3.0]), (9, 2, [1e30, 0.0]), (10, 3, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, id string, v int")
    got = sorted((r.id, r.label, r.v) for r in hard_negatives.whole(df).collect())
    assert got == [(0, 1, [128, -1]), (7, 1, [0, 0]), (8, 1, [768, 768])]
    assert hard_negatives.mine(hard_negatives.whole(df.limit(0))).count() == 0
    # Scores beyond 2**53 stay exact.
    big = [(0, 1, [2 ** 30, 3]), (1, 1, [2 ** 30, 1]), (2, 2, [2 ** 29, 1]), (3, 2, [2 ** 29, 2])]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(big, "id long, label long, v array<long>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3, 2 ** 60 + 3, 2 ** 59 + 6), (0, 1, 2, 2, 2 ** 60 + 3, 2 ** 59 + 3)]


@pytest.mark.parametrize("name", ["op11_reply_trees", "op12_merkle_manifest", "op13_bond_scan"])
def test_queries_on_odd_tables(spark, tmp_path, name):
    """Nulls, repeated rows and clashing columns give the rows that the SQL gives."""
    tables = {
        "conversations": ("conv_id long, turn long, role string, text string, leaf string, n long", [(c, t, r, x, "l", 1) for c in (None, 1, 2, -1) for t, r, x in [(0, "user", ODD[1]), (1, "assistant", None), (1, "assistant", ODD[6]), (3, "a|b", ODD[7])]]),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long, digest string, key string", [(i % 90, rnd.choice([None, "", "t <é>", "w " * 9000]), rnd.choice([None, "de", "en", "en"]), rnd.choice([None, "s"]), rnd.choice([None, 3]), "d", "k") for i in range(130)]),
        "embeddings": ("vec_id long, embedding array<float>, label int, id int, v int", [(i, None if i % 11 == 3 else [float(x) for x in rnd.choices([-0.5, 0.1, 0.7, 0.3], k=6)], None if i % 13 == 5 else i % 3, 0, 0) for i in range(401)]),
    }
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = e.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect()) == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
