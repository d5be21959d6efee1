"""SQL (DuckDB) that gives the rows of the queries SQL can express."""

from __future__ import annotations

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)"""

OP1 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % 2147483647 AS v FROM l),
r AS (SELECT *, (coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) * 1000003 + v) % 2147483647 % 4 = 0 AS last FROM h),
c AS (SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
g AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS whole, count(*) AS n,
             count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS filled FROM c GROUP BY 1, 2),
m AS (SELECT *, filled > 1 AND row_number() OVER (PARTITION BY whole ORDER BY doc_id, k) > 1 AS gone FROM g),
o AS (SELECT doc_id, string_agg(whole, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS t, sum(n) AS lines, count(*) AS chunks,
             count(*) FILTER (WHERE gone) AS gone_chunks, sum(n) FILTER (WHERE gone) AS gone_lines FROM m GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, CAST(coalesce(lines, 0) AS BIGINT) AS line_count,
       coalesce(chunks, 0) AS chunk_count, coalesce(gone_chunks, 0) AS removed_chunks, CAST(coalesce(gone_lines, 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN o USING (doc_id)"""

_WORD = "'[^\\x20\\x09-\\x0D]+'"

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
w AS (SELECT doc_id, lang, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT doc_id, i, word, lead(word) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(lines.n, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words,
                [length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
                 length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')), length(regexp_replace(text, '[^.,;:''"!?()-]', '', 'g')),
                 length(regexp_replace(text, '[a-zA-Z0-9\\x20\\x09-\\x0D.,;:''"!?()\\x80-\\x{{10FFFF}}-]', '', 'g')), length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))] AS cls
         FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
long_words AS (SELECT lang, word, count(*) AS c FROM w WHERE n >= 50 GROUP BY 1, 2),
totals AS (SELECT lang, sum(c) AS c FROM long_words GROUP BY 1 HAVING sum(c) >= 0.0005 * (SELECT sum(c) FROM long_words)),
common AS (SELECT lang, word, c FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS place FROM long_words WHERE lang IN (SELECT lang FROM totals)) WHERE place <= 32),
ref AS (SELECT lang, word, CAST(common.c AS DOUBLE) / totals.c AS q FROM common JOIN totals USING (lang)
        UNION ALL SELECT lang, NULL, 1 - sum(CAST(common.c AS DOUBLE)) / any_value(totals.c) FROM common JOIN totals USING (lang) GROUP BY 1),
without AS (SELECT lang, sqrt((log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END + 1 - q) / 2) AS far FROM ref WHERE word IS NULL AND 1 - q >= 0.1),
own AS (SELECT doc_id, w.lang, common.word, CAST(count(*) AS DOUBLE) / any_value(n) AS p FROM w LEFT JOIN common ON w.lang = common.lang AND w.word = common.word GROUP BY 1, 2, 3),
word_d AS (SELECT doc_id, sqrt(greatest(0, (sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(q)) / 2)) AS d
           FROM own JOIN ref ON own.lang = ref.lang AND own.word IS NOT DISTINCT FROM ref.word GROUP BY 1),
cls AS (SELECT doc_id, lang, n_words, unnest(cls) AS c, generate_subscripts(cls, 1) AS k, list_sum(cls) AS chars FROM base),
cls_ref AS (SELECT lang, k, CAST(sum(c) AS DOUBLE) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM cls WHERE n_words >= 50 AND lang IN (SELECT lang FROM totals) GROUP BY 1, 2),
char_d AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN c > 0 THEN c / chars * log2(2 * c / chars / (c / chars + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (c / chars + q)) ELSE 0 END) / 2)) AS d
           FROM cls JOIN cls_ref USING (lang, k) WHERE chars >= 200 GROUP BY 1),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_d.d, 0) <= 0.28 AND (far IS NULL OR coalesce(word_d.d, 0) <= 0.95 * far) AS kept
FROM b LEFT JOIN char_d USING (doc_id) LEFT JOIN word_d USING (doc_id) LEFT JOIN without USING (lang)"""


def _share_out(nodes: str, out: str, keys: list[str]) -> str:
    """CTEs that share ``budget`` among the rows of ``nodes`` with equal parents (all ``keys`` but the last)."""
    parents = ", ".join(keys[:-1]) or "1"
    order = f"PARTITION BY {parents} ORDER BY cap * 1000000 // w, {keys[-1]}"
    past = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    every = f"(PARTITION BY {parents})"
    return f"""
{out}_a AS (SELECT *, cap * (sum(w) OVER {every} - coalesce(sum(w) OVER {past}, 0)) <= w * (budget - coalesce(sum(cap) OVER {past}, 0)) AS used_up FROM {nodes}),
{out}_b AS (SELECT *, budget - sum(CASE WHEN used_up THEN cap ELSE 0 END) OVER {every} AS rest, sum(CASE WHEN used_up THEN 0 ELSE w END) OVER {every} AS w_open FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN used_up THEN cap ELSE rest * w // w_open END AS even FROM {out}_b),
{out} AS (SELECT *, least(cap, even + CASE WHEN NOT used_up AND row_number() OVER (PARTITION BY {parents} ORDER BY used_up, cap * 1000000 // w, {keys[-1]})
                      <= rest - sum(CASE WHEN used_up THEN 0 ELSE even END) OVER {every} THEN 1 ELSE 0 END) AS got FROM {out}_c)"""


def op4(levels: list[str], domain: str, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: str) -> str:
    ctes, before = [], None
    for depth, level in enumerate(levels):
        keys = levels[:depth + 1]
        w = " ".join(f"WHEN {level} = '{v}' THEN {n}" for v, n in weights.get(level, {}).items())
        weight = f"CASE {w} ELSE 1 END" if w else "1"
        cols = ", ".join(f"leaves.{k}" for k in keys)
        source = f"leaves JOIN {before} USING ({', '.join(keys[:-1])})" if before else "leaves"
        budget = f"any_value({before}.got)" if before else f"(SELECT least(sum(tokens) * {share[0]} // {share[1]}, sum(tokens) * {epochs}) FROM leaves)"
        names = ", ".join(keys)
        ctes.append(f"n{depth} AS (SELECT {names}, sum(cap) AS cap, {weight} AS w, {budget} AS budget FROM {source} GROUP BY {names})" if before is None else
                    f"n{depth} AS (SELECT {names}, sum(leaves.cap) AS cap, {weight} AS w, {budget} AS budget FROM {source} GROUP BY {names})")
        ctes.append(_share_out(f"n{depth}", f"g{depth}", keys))
        before = f"g{depth}"
    names = ", ".join(levels)
    return f"""
WITH docs AS (SELECT doc_id, {', '.join(f"coalesce({c}, '(none)') AS {c}" for c in levels)}, tokens FROM (
        SELECT doc_id, lang, source, {domain} AS domain, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS tokens FROM documents) WHERE doc_id IS NOT NULL AND tokens > 0),
leaves AS (SELECT {names}, sum(tokens) AS tokens, sum(tokens) * {epochs} AS cap FROM docs GROUP BY {names}),
{', '.join(ctes)},
plan AS (SELECT {names}, got // tokens AS full_epochs, got % tokens AS rest FROM leaves JOIN {before} USING ({names})),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {names} ORDER BY substr(md5(concat_ws('|', '{seed}', full_epochs, doc_id)), 1, 16), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs JOIN plan USING ({names})),
e AS (SELECT *, unnest(range(0, CAST(full_epochs AS BIGINT) + 1)) AS epoch FROM o)
SELECT doc_id, {names}, CAST(epoch AS INT) AS epoch, tokens, CAST(taken AS BIGINT) AS taken
FROM (SELECT *, CASE WHEN epoch < full_epochs THEN tokens ELSE greatest(0, least(tokens, rest - before)) END AS taken FROM e) WHERE taken > 0"""


def op11(marked: str) -> str:
    plain = "string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{marked}'), (-1, 1, 'assistant', '{marked}')),
m AS (SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS escaped,
             replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '|', '\\p') AS named FROM c)
SELECT conv_id, count(*) AS n_turns, sha256({plain}) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || named || chr(10) || escaped || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


OP12 = """
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, source, text, CAST(doc_id AS VARCHAR) AS name FROM documents),
z AS (SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(name) + 1), lambda i: [CAST(ascii(substr(name, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
             lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc FROM f),
d AS (SELECT *, coalesce(octet_length(encode(name)) || ':' || name, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
             || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
             n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS seen FROM z),
l AS (SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
             sha256(head || coalesce(length(CAST(seen AS VARCHAR)) || ':' || seen, '-') || body) AS now FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
tree AS (SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM r
       UNION ALL SELECT lang, level, pos, node, count(*) OVER (PARTITION BY lang) FROM (
           SELECT lang, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2)),
subs AS (SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM subs
        UNION ALL SELECT level, pos, node, count(*) OVER () FROM (
            SELECT level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM top WHERE n > 1 GROUP BY level, pos // 2)),
step AS (SELECT a.lang, a.level, a.pos, b.node AS beside, b.pos < a.pos AS before FROM tree a LEFT JOIN tree b
           ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
beyond AS (SELECT a.level, a.pos, b.node AS beside, b.pos < a.pos AS before FROM top a LEFT JOIN top b ON a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
ways AS (SELECT r.doc_id, r.lang, r.pos, r.leaf, r.now, s.level, s.beside, s.before FROM r JOIN step s ON r.lang IS NOT DISTINCT FROM s.lang AND s.pos = r.pos >> s.level
         UNION ALL SELECT r.doc_id, r.lang, r.pos, r.leaf, r.now, subs.height + o.level, o.beside, o.before
         FROM r JOIN subs ON r.lang IS NOT DISTINCT FROM subs.lang JOIN beyond o ON o.pos = subs.place >> o.level),
path AS (SELECT lang, pos, list({'beside': coalesce(beside, ''), 'first': coalesce(before, false)} ORDER BY level) AS p, string_agg(coalesce(beside, ''), '' ORDER BY level) AS proof FROM ways GROUP BY 1, 2),
whole AS (SELECT r.*, coalesce(proof, '') AS proof, list_concat([{'beside': now, 'first': false}], coalesce(p, [])) AS p
          FROM r LEFT JOIN path ON r.lang IS NOT DISTINCT FROM path.lang AND r.pos = path.pos),
folded AS (SELECT *, list_reduce(p, lambda a, x: {'beside': sha256(CASE WHEN x.first THEN x.beside || a.beside ELSE a.beside || x.beside END), 'first': false}).beside AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = (SELECT node FROM top WHERE n = 1) AS verified
FROM folded JOIN subs ON folded.lang IS NOT DISTINCT FROM subs.lang"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
