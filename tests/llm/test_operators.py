"""Small cases of every operator beside a plain computation of the same result."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as e
import corpus_pipeline
from check import norm
from gridair.llm import budget_tree, capture_index, compact_windows, dac, divergence, kneser_ney, line_chunks, packing, permutation_index, queries, simhash_rings
from gridair.llm.tokens import encoder, vocabulary_path
from gridair.llm.words import common_words

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, tokens string, uid int, block string, key string, kept string"
rnd = random.Random(3)
WORDS = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "e", "io", "un", "ath", "ing")]


def prose(n):
    return " ".join(rnd.choices(WORDS, k=n))


PASSAGE = prose(60)
ODD = [(1, prose(80) + "\n" + PASSAGE + "\n" + prose(30)), (2, PASSAGE + "\n" + prose(90)), (3, None), (4, ""), (5, " \n\t"), (6, "Ein Wort"), (7, "x " * 30_000), (8, "x " * 30_000),
       (9, "same text here\nand there " + prose(40)), (9, "same text here\nand there " + prose(40)), (10, "a\nb\nc\nd\ne\nf\ng"), (11, "a\nb\nc\nd\ne\nf\ng"), (12, "Ünïcödé ‘quotes’ 中文 🙂 'S don't İ"),
       (None, prose(70)), (13, prose(400)), (14, "<|endoftext|> <p>|</p>")]
ODD += ODD[:1]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], [None, "src0", "src1"][k % 2 + (k % 5 > 0)], None, "h", "t", 1, "b", "k", "x") for k, (i, t) in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return [(i, (t or "").encode()) for i, t in ODD]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = e.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect())
    assert got == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_line_chunks(spark, odd, empty):
    rows = line_chunks.dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[3][0].text is None and by[3][0].line_count == 0 and by[4][0].text == ""
    assert by[10][0].removed_lines == 0 and by[11][0].removed_lines > 0 and len(by[11][0].text) < 13
    assert len({r.text for r in by[1]}) == 1  # repeated rows alike
    assert by[1][0].hash == "h" and line_chunks.dedup(empty).count() == 0
    # Lines put in before shift no border after the window.
    lines = [prose(8).encode() for _ in range(200)]
    a, b = line_chunks.chunk_bounds(lines), line_chunks.chunk_bounds([b"new", b"lines", *lines])
    assert set(x for x in a if x > 3) == set(x - 2 for x in b if x > 5)


def test_divergence(spark, odd, empty):
    rows = divergence.judge(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.n_words >= 50 or (r.base_failed and not r.kept)
    seven = next(r for r in rows if r.doc_id == 7)
    assert seven.n_words == seven.n_repeat_words == 30_000 and seven.base_failed
    assert divergence.repeated_words(b"a b c x a b c".split()) == 6 and divergence.judge(empty).count() == 0
    assert divergence.distance(np.array([1, 0]), np.array([0, 1])) == 1 and divergence.distance(np.array([2, 2]), np.array([1, 1])) == 0
    clean = spark.createDataFrame([(i, prose(300), "en") for i in range(60)] + [(99, " | ".join(prose(300).upper().split()), "en"), (98, " ".join(w + "%%" for w in prose(300).split()), "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in divergence.judge(clean).where("not kept").collect()} == {98, 99}


def test_words_tell_languages(spark):
    """Foreign text, made-up words and a small language; clean texts stay."""
    stock = {lang: [f"{lang}{i}" for i in range(2000)] for lang in ("aa", "bb", "cc")}
    weights = [1 / (k + 1) for k in range(2000)]
    text = lambda lang, n=150: " ".join(rnd.choices(stock[lang], weights, k=n))
    docs = [(i, text("aa"), "aa") for i in range(700)] + [(1000 + i, text("bb"), "bb") for i in range(290)] + [(2000 + i, text("cc"), "cc") for i in range(5)]
    docs += [(3000 + i, text("bb"), "aa") for i in range(10)] + [(4000 + i, text("aa"), "cc") for i in range(1)]
    docs += [(5000 + i, " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(150)), "aa") for i in range(10)]
    docs += [(6000 + i, text("aa", 30) + " " + " ".join(f"x{rnd.random()}" for _ in range(30)), None) for i in range(3)]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), limits=(1.0, divergence.WORD_LIMIT)).collect()}
    assert len(got) == len(docs)
    assert all(got[i].kept for i in got if i < 3000) and not any(got[i].kept for i in got if 3000 <= i < 6000)


def test_words_that_cover_too_little_are_not_judged(spark):
    docs = [(i, " ".join(f"w{rnd.random()}" for _ in range(80)), "zz") for i in range(60)]
    got = divergence.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), limits=(1.0, divergence.WORD_LIMIT)).collect()
    assert all(r.kept and r.word_distance is None for r in got)


def test_common_words_exact(spark, monkeypatch):
    from gridair.llm import words as module
    monkeypatch.setattr(module, "HELD", 40)  # several reports a task
    rows = [(["en", "de", None, "en", "de", None, "xx"][i % 7], prose(rnd.randint(0, 90)) + (" rare%d" % i)) for i in range(200)] + [("xx", "a")]
    found, totals = common_words(spark.createDataFrame(rows, "lang string, text string").repartition(7), 9, 0.2, 20)
    plain = defaultdict(lambda: defaultdict(int))
    for lang, text in rows:
        own = text.encode().split()
        for w in own if len(own) >= 20 else ():
            plain[lang][w] += 1
    total = {lang: sum(ws.values()) for lang, ws in plain.items()}
    large = {lang for lang in total if total[lang] >= 0.2 * sum(total.values())}
    assert totals == {lang: total[lang] for lang in large} and "xx" not in large
    assert found == {lang: dict(sorted(plain[lang].items(), key=lambda x: (-x[1], x[0]))[:9]) for lang in large}


def test_compact_windows(spark, odd, empty):
    for _ in range(60):
        x = np.array([rnd.randint(0, 9 if rnd.random() < .3 else 10_000) for _ in range(rnd.randint(0, 120))], np.int64)
        size = rnd.randint(1, 20)
        left, c, right = compact_windows.compact_windows(x, size)
        plain = []
        for k in range(len(x)):
            i, j = k, k
            while i > 0 and x[i - 1] > x[k]:
                i -= 1
            while j + 1 < len(x) and x[j + 1] >= x[k]:
                j += 1
            if j - i + 1 >= size:
                plain.append((i, k, j))
        assert sorted(zip(left.tolist(), c.tolist(), right.tolist())) == sorted(plain)
    found = {r.doc_id: r for r in compact_windows.near_passages(odd).collect()}
    assert {1, 2, 7, 8} <= set(found) and not {3, 4, 5, 6, 10, 12, 13, 14} & set(found)
    assert found[2].class_id == 1 and found[8].class_id == 7
    at = len(ODD[0][1].split("\n")[0].split())
    assert any(s["first"] <= at and at + 60 <= s["end"] for s in found[1].spans) and any(s["first"] <= 0 and s["end"] >= 60 for s in found[2].spans)
    assert compact_windows.near_passages(empty).count() == 0


def test_hot_passage_and_common_line(spark):
    line = prose(20)
    docs = [(i, f"{prose(40)} {PASSAGE} {prose(30)}" if i % 3 == 0 else f"{prose(60)} {line} {prose(60)}" if i % 3 == 1 else prose(150)) for i in range(300)]
    found = {r.doc_id: r.class_id for r in compact_windows.near_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(found) == {i for i, _ in docs if i % 3 == 0} and set(found.values()) == {0}


def test_copies_give_no_pairs_of_copies(spark):
    row = "key long, uid long, start int, stop int, at int, body long"
    rows = [(5, u, 3, 9, 4, 100) for u in range(500)] + [(5, u, 3, 9, 4, 200) for u in range(400, 900)] + [(5, 950, 0, 0, 0, 300), (6, 951, 0, 0, 0, 400)]
    members = compact_windows.bodies(spark.createDataFrame(rows, row)).collect()
    assert len([r for r in members if r["first"] is not None]) == 1000 and all(r.uid != r["first"] for r in members)
    standing = spark.createDataFrame([tuple(r[c] for c in compact_windows.ROW) for r in members if r.key is not None], row)
    assert sorted((r.uid, r.body) for r in standing.collect()) == [(0, 100), (400, 200), (950, 300)]
    classes = lambda *pairs: spark.createDataFrame(list(pairs), "node long, root long")
    pairs = lambda known: {(r.uid, r["first"]) for r in compact_windows.apart(standing, known).collect()}
    assert pairs(classes((0, 0))) == {(400, 0), (950, 0), (950, 400)}
    assert pairs(classes((0, 0), (400, 0))) == {(950, 0), (950, 400)} and not pairs(classes((0, 0), (400, 0), (950, 0)))


def test_similar_texts_beside_every_pair(spark):
    """Classes of texts with edited passages beside the sets of all pairs of passages; some are linked by others only."""
    texts = []
    for _ in range(25):
        words = [f"w{rnd.randint(0, 10**9)}" for _ in range(51)]
        for k in (0, 3, 5, 9):  # each differs from the one before more than from none, first and last by too much
            words = [*words[:k], f"n{k}{rnd.randint(0, 10**9)}", *words[k + 1:]]
            texts.append(" ".join([*(f"a{rnd.randint(0, 10**9)}" for _ in range(rnd.randint(0, 9))), *words]))
        turned = words[20:50] + words[:20]
        texts.append(" ".join(turned))
    rnd.shuffle(texts)
    sets = []
    for t in texts:
        w = t.split()
        shingles = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        sets.append([set(shingles[i:i + 46]) for i in range(len(shingles) - 45)])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if any(len(x & y) >= 0.8 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    found = {r.doc_id: r.class_id for r in compact_windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == want and len(want) > 60


def test_mix(spark, odd, empty):
    docs = odd.withColumn("tokens", budget_tree.n_words("text"))
    got = budget_tree.mix(docs, ["lang", "source"], {"lang": {"en": 5}}, (3, 2), 3, "s").collect()
    tokens = {i: len(t.split()) for i, t in texts() if i is not None}
    assert sum(r.taken for r in got) == sum(tokens.values()) * 3 // 2
    assert all(0 < r.taken <= r.tokens for r in got) and len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert sum(r.taken < r.tokens for r in got) <= len({(r.lang, r.source) for r in got})
    assert budget_tree.mix(empty.withColumn("tokens", budget_tree.n_words("text")), ["lang"], {}, (1, 2), 1, "s").count() == 0
    # A leaf that runs short leaves its part to its sibling, not to the other branch.
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "z", 500)], "d string, s string, tokens long")
    assert {(r.d, r.s): r.got for r in budget_tree.budgets(leaves, ["d", "s"], {}, (400, 1010), 1).collect()} == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    cut = spark.createDataFrame([(" a b\n c d ", 2)], "t string, n int").select(budget_tree.first_words("t", "n").alias("t")).first().t
    assert cut == " a b"


def test_tokens_and_codes(spark, odd, empty):
    from tokenizers import Tokenizer
    alphabet = "aAbZé ñÉ́ '_.9²Ⅷ \n\t\r\xa0 \x1c\x85sStTrREevVlLdDmM!$'  中ΣςİKſ🙂­​"
    some = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(vocabulary_path(name))
        plain.encode_special_tokens = True
        enc = encoder(vocabulary_path(name))
        want = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(b, f"<u{enc.width}").tolist() for b in enc.encode([s.encode() for s in some])] == want
    files = dac.write(odd.repartition(5), vocabulary_path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    start, want = 0, []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, dac.digest(dac.read_documents(files)).collect()))) == sorted(map(repr, want))
    assert dac.digest(dac.read_documents(dac.write(empty, vocabulary_path("byte_bpe_50k.json")))).count() == 0


def test_codes_random_access(tmp_path):
    ids = np.array([rnd.choice([3, 200, 255, 256, 50_000, 70_000, 2**24, 2**32 - 1]) for _ in range(5000)], np.uint32)
    path = tmp_path / "x.dac"
    path.write_bytes(dac.encode(ids, np.array([1]), np.array([0, 5000])))
    f = dac.DacFile(str(path))
    assert [f.token(i) for i in range(0, 5000, 37)] == ids[::37].tolist()
    for _ in range(50):
        i = rnd.randint(0, 4999)
        j = rnd.randint(i, 5000)
        assert f.read(i, j).tolist() == ids[i:j].tolist() if j > i else True


def test_kneser_ney(spark, empty):
    lm = [" ".join(rnd.choices(WORDS[:20], weights=range(20, 0, -1), k=rnd.randint(30, 300))) for _ in range(200)]
    odd_words = [" ".join(rnd.choices(WORDS[20:], k=120)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(lm + odd_words)] + [(900, None, "en"), (901, "short", None), (None, lm[0], "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(150)] + [(None,), (3,)], "doc_id long")
    rows = kneser_ney.classify(docs, trusted).collect()
    assert len(rows) == 208 and {r.doc_id for r in rows if not r.kept} >= set(range(200, 205))
    assert sum(not r.kept for r in rows if r.doc_id is not None and r.doc_id < 200) <= 8
    assert next(r for r in rows if r.doc_id == 900).perplexity is None
    assert kneser_ney.classify(empty, trusted).count() == 0


def plain_fingerprint(text):
    words = text.lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, empty):
    got = simhash_rings.near_duplicates(odd)
    rows = got.collect()
    fps = [(i, plain_fingerprint(t)) for i, t in texts()]
    assert sorted((r.doc_id or 0, r.fp % 2**64) for r in rows) == sorted((i or 0, f) for i, f in fps)
    assert simhash_rings.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [256, 3])
def test_simhash_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_rings, "HOT", hot)
    fps = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(set(fps))
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[i + 1:]:
            if (x ^ y).bit_count() <= 4:
                parent[root(x)] = root(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    from gridair.llm.common import components
    comp = {r.node % 2**64: r.root for r in components(simhash_rings.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    groups = lambda f: sorted(sorted(g) for g in _groups(fps, f))
    assert groups(root) == groups(lambda x: comp.get(x, ("own", x)))


def _groups(items, key):
    out = defaultdict(list)
    for x in items:
        out[key(x)].append(x)
    return out.values()


def test_captures(spark):
    same = "<html>" + "y" * 200
    rows = [(5, "http://a.b.org/x", same), (3, "https://user@C.org:443/?q#f", same), (9, "http://a.b.org/x", same), (4, None, same), (7, "http://z.org", None), (8, "http://z.org", "short"), (6, "http://z.org", "short"),
            (None, "http://n.org/ü", "q" * 150), (10, "http://n.org/ü", "q" * 150), (3, "http://twice.org", same)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    files = capture_index.write_index(capture_index.write_archives(pages))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in capture_index.verify(capture_index.lookup(pages, files)).collect()}
    assert got == {(3, 206, "response", None), (4, 206, "revisit", 3), (5, 206, "revisit", 3), (9, 206, "revisit", 3), (7, 0, "response", None), (8, 5, "response", None), (6, 5, "response", None),
                   (10, 150, "response", None), (None, 150, "revisit", 10)}
    assert capture_index.url_key("https://user@C.org:443/?q#f") == "org,c)/?q" and capture_index.url_key("http://a.b.org:8080") == "org,b,a:8080)/"
    none = pages.limit(0)
    assert capture_index.verify(capture_index.lookup(none, capture_index.write_index(capture_index.write_archives(none)))).count() == 0
    index = capture_index.CaptureIndex([tuple(r) for r in files.collect()])
    assert [c[1] for c in index.find("org,b,a)/x")] == [5, 9] and index.find("org,nothing)/") == []


def test_index_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK", 4)
    captures = spark.createDataFrame([(f"org,h{i % 5})/", i, "a", i, 1) for i in range(100)], capture_index.CAPTURE)
    index = capture_index.CaptureIndex([tuple(r) for r in capture_index.write_index(captures.coalesce(1)).collect()])
    for i in range(100):
        assert [c[3] for c in index.find(f"org,h{i % 5})/", i)] == [i]
    assert len(index.find("org,h2)/")) == 20


def test_packing(spark, odd, empty):
    parts = packing.pieces(odd, vocabulary_path("word_bpe_49k.json"))
    packed = packing.pack(parts).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and sum(r.start == 0 for r in packed) == len(ODD)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 2 * r.length
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    assert sorted(by) == list(range(len(by)))
    assert packing.digest(packing.pack(packing.pieces(empty, vocabulary_path("word_bpe_49k.json")))).count() == 0
    found = packing.patterns({10: 7, 6: 3, 4: 5, 1: 100}, 10)
    assert sum(c * p.count(6) for c, p in found) == 3 and sum(c * p.count(1) for c, p in found) == 100 and all(sum(p) <= 10 for _, p in found)


def test_permutation_index_in_blocks_of_queries_and_shards(spark, monkeypatch):
    """Blocks and shards deal the work out; with every entry ranked again the result is the brute force's."""
    monkeypatch.setattr(permutation_index, "BLOCK", 3)
    monkeypatch.setattr(permutation_index, "SHARD", 50)
    monkeypatch.setattr(permutation_index, "LEAST", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in permutation_index.search(df, "vec_id % 20 = 0", 4).collect()}
    far = lambda q: sorted((np.sqrt(((x[i] - x[q]) ** 2).sum()), i) for i in range(300) if i != q)[:4]
    assert got == {(q, k + 1): i for q in range(0, 300, 20) for k, (_, i) in enumerate(far(q))}


def test_permutation_index(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0]), (1400, [None] * 16), (None, x[3].tolist()), (500, x[500].tolist())]
    got = permutation_index.search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")).toPandas()
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        want = np.lexsort((np.arange(900), d))[:10]
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], d[own["vec_id"]])
        hit += len(set(want) & set(own["vec_id"]))
    assert set(got.query_id) == set(range(0, 900, 100)) and hit >= 81
    zero = got[got.query_id == 300].sort_values("rank")
    assert zero["vec_id"].tolist() == [0, *range(301, 310)]
    assert permutation_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            if name != "packing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    cut = corpus_pipeline.line_dedup(spark, kept, FOLDER)
    one = {r.doc_id for r in corpus_pipeline.near_dedup(spark, cut, FOLDER).collect()}
    assert one == {r.component_id for r in simhash_rings.near_duplicates(cut).collect()}
    mixed = corpus_pipeline.mixing(spark, cut, FOLDER).collect()
    full = {r.doc_id: r.text for r in cut.collect()}
    words = lambda t: len(t.encode().split())
    assert sum(words(r.text) for r in mixed) == sum(map(words, full.values())) * 9 // 10
    assert all(full[r.doc_id].startswith(r.text) for r in mixed)
    got = e.queries()["pipeline"](spark, FOLDER).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert by and all(sum(n for _, n, _ in v) == v[0][2] for v in by.values())
