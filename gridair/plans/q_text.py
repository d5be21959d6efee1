"""Queries over messages, texts and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.operators import facts as X
from gridair.operators import text as T
from gridair.plans.q_facts import _SUM, rr
from gridair.plans.registry import query

TODAY = "DATE '2024-06-30'"


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


def today():
    return F.lit("2024-06-30").cast("date")


# Requests written out from the order rows.
_REQ = """
rq AS (SELECT o_orderkey AS id, CASE o_orderkey % 8
  WHEN 0 THEN concat('Show the NO2 map for Mumbai on ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR))
  WHEN 1 THEN concat('Please forecast Pune for ', CAST(o_orderkey % 48 + 1 AS VARCHAR), ' hours')
  WHEN 2 THEN concat('Generate report Delhi ', CAST(day(o_orderdate) AS VARCHAR), '/', CAST(month(o_orderdate) AS VARCHAR), '/', CAST(year(o_orderdate) AS VARCHAR), ' in Hindi')
  WHEN 3 THEN concat('compare ', o_orderpriority, ' standard near thane today')
  WHEN 4 THEN concat('hello from ', o_orderpriority) WHEN 5 THEN concat('Predict ', CAST(o_orderkey % 5 AS VARCHAR), ' days near a factory')
  WHEN 6 THEN concat('Where is the worst place at 19.', CAST(o_orderkey % 900 + 100 AS VARCHAR), '°N, 72.', CAST(o_custkey % 900 + 100 AS VARCHAR), '°E yesterday')
  ELSE concat('(', CAST(o_orderkey % 120 AS VARCHAR), '.5, -', CAST(o_custkey % 200 AS VARCHAR), ') people exposed ', o_orderstatus) END AS text FROM orders)"""


def requests(t: Tables):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    s = lambda c: c.cast("string")
    lit = F.lit
    text = (F.when(k % 8 == 0, F.concat(lit("Show the NO2 map for Mumbai on "), s(d)))
            .when(k % 8 == 1, F.concat(lit("Please forecast Pune for "), s(k % 48 + 1), lit(" hours")))
            .when(k % 8 == 2, F.concat(lit("Generate report Delhi "), s(F.day(d)), lit("/"), s(F.month(d)), lit("/"), s(F.year(d)), lit(" in Hindi")))
            .when(k % 8 == 3, F.concat(lit("compare "), "o_orderpriority", lit(" standard near thane today")))
            .when(k % 8 == 4, F.concat(lit("hello from "), "o_orderpriority"))
            .when(k % 8 == 5, F.concat(lit("Predict "), s(k % 5), lit(" days near a factory")))
            .when(k % 8 == 6, F.concat(lit("Where is the worst place at 19."), s(k % 900 + 100), lit("°N, 72."), s(F.col("o_custkey") % 900 + 100), lit("°E yesterday")))
            .otherwise(F.concat(lit("("), s(k % 120), lit(".5, -"), s(F.col("o_custkey") % 200), lit(") people exposed "), "o_orderstatus")))
    return t.orders.select(k.alias("id"), text.alias("text"))


def _has(words):
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


_PARSED = f"""{_REQ}, lo AS (SELECT *, lower(text) AS l FROM rq),
ac AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_has(T.INTENT_KEYWORDS[a])} THEN '{a}' END" for a in T.ACTION_INTENTS)}], lambda x: x IS NOT NULL) AS acts,
  regexp_extract(text, '\\b(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{4}})\\b', ['d', 'm', 'y']) AS s FROM lo),
pr AS (SELECT id, text, CASE WHEN len(acts) > 1 THEN 'multi_task' WHEN len(acts) = 1 THEN acts[1] WHEN {_has(T.INTENT_KEYWORDS['help'])} THEN 'help'
   WHEN {_has(T.INTENT_KEYWORDS['greeting'])} THEN 'greeting' ELSE 'general_question' END AS intent,
 CASE {' '.join(f"WHEN contains(l, '{c}') THEN '{c.title()}'" for c in T.CITY_BOXES)} END AS location,
 CASE {' '.join(f"WHEN contains(l, '{c}') THEN '{b}'" for c, b in T.CITY_BOXES.items())} END AS bbox,
 coalesce(TRY_CAST(regexp_extract(l, '(?:for\\s+)?(\\d+)\\s*(?:hour|hr|h)\\b', 1) AS INT), 24 * TRY_CAST(regexp_extract(l, '(?:for\\s+)?(\\d+)\\s*(?:day|d)\\b', 1) AS INT),
   CASE WHEN contains(l, 'two hour') THEN 2 WHEN contains(l, 'one day') OR contains(l, '24 hour') OR contains(l, 'a day') THEN 24 END) AS forecast_hours,
 coalesce(TRY_CAST(regexp_extract(text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS DATE), TRY_CAST(CASE WHEN s.y <> '' THEN concat(s.y, '-', lpad(s.m, 2, '0'), '-', lpad(s.d, 2, '0')) END AS DATE),
   CASE WHEN contains(l, 'today') THEN {TODAY} WHEN contains(l, 'yesterday') THEN {TODAY} - 1 WHEN contains(l, 'tomorrow') THEN {TODAY} + 1 END) AS observation_date,
 CASE WHEN contains(l, 'hindi') THEN 'hi' WHEN contains(l, 'marathi') THEN 'mr' ELSE 'en' END AS language FROM ac)"""


@query("txt_02_parse_requests", f"WITH {_PARSED} SELECT id, intent, location, bbox, forecast_hours, observation_date, language FROM pr")
def txt_02(t: Tables):
    return T.parse_requests(requests(t), today()).drop("text")


@query("txt_02_parse_conversations", f"""
WITH lo AS (SELECT conv_id, turn, lower(text) AS l FROM messages), ac AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_has(T.INTENT_KEYWORDS[a])} THEN '{a}' END" for a in T.ACTION_INTENTS)}], lambda x: x IS NOT NULL) AS acts FROM lo)
SELECT conv_id, turn, CASE WHEN len(acts) > 1 THEN 'multi_task' WHEN len(acts) = 1 THEN acts[1] WHEN {_has(T.INTENT_KEYWORDS['help'])} THEN 'help'
 WHEN {_has(T.INTENT_KEYWORDS['greeting'])} THEN 'greeting' ELSE 'general_question' END AS intent FROM ac""")
def txt_02b(t: Tables):
    return T.parse_requests(t.messages, today()).select("conv_id", "turn", "intent")


@query("txt_03_missing_fields", f"""
WITH {_PARSED}, n AS (SELECT *, CASE intent WHEN 'downscale' THEN ['bbox', 'observation_date'] WHEN 'forecast' THEN ['bbox', 'observation_date'] WHEN 'report' THEN ['bbox', 'observation_date', 'location']
  WHEN 'hotspot' THEN ['bbox'] WHEN 'analysis' THEN ['bbox', 'observation_date', 'location'] ELSE [] END AS need FROM pr),
m AS (SELECT id, list_filter(need, lambda f: NOT (CASE f WHEN 'bbox' THEN bbox IS NOT NULL WHEN 'location' THEN location IS NOT NULL ELSE observation_date IS NOT NULL END)) AS missing_fields FROM n)
SELECT id, missing_fields, CASE WHEN len(missing_fields) > 0 THEN 'need_info' ELSE 'executing' END AS status FROM m""")
def txt_03(t: Tables):
    return T.missing_fields(T.parse_requests(requests(t), today())).select("id", "missing_fields", "status")


@query("txt_12_question_topic", f"""
WITH {_REQ}, q AS (SELECT id, lower(text) AS t FROM rq UNION ALL SELECT conv_id * 1000 + turn + 100000000, lower(text) FROM messages)
SELECT id, CASE WHEN regexp_matches(t, 'drone|fly|flight|inspect') THEN 'drone' WHEN regexp_matches(t, 'unusual|suspicious|anomal|illegal|spike|sudden|strange') THEN 'unusual'
 WHEN regexp_matches(t, 'forecast|tomorrow|tonight|next|later|hour|predict|will it') THEN 'forecast' WHEN regexp_matches(t, 'trend|better|worse|improv|week|month|over time|history') THEN 'trend'
 WHEN regexp_matches(t, 'hotspot|where|worst|highest|area.*(most|high)') THEN 'hotspots' WHEN regexp_matches(t, 'how many|people|population|exposed|precaution') THEN 'exposure'
 WHEN regexp_matches(t, 'limit|standard|cpcb|naaqs|who|guideline|within|comply|complian') THEN 'standards' ELSE 'fullcheck' END AS topic FROM q""")
def txt_12(t: Tables):
    q = requests(t).unionByName(t.messages.select((F.col("conv_id") * 1000 + F.col("turn") + 100000000).alias("id"), "text"))
    return q.select("id", T.question_topic(F.col("text")).alias("topic"))


@query("txt_13_parse_coordinates", f"""
WITH {_REQ}, g AS (SELECT id, regexp_extract(trim(text), '([+-]?\\d+(?:\\.\\d+)?)\\s*°?\\s*([NSns])?[,\\s]+([+-]?\\d+(?:\\.\\d+)?)\\s*°?\\s*([EWew])?', ['a', 'b', 'c', 'd']) AS g,
  regexp_extract_all(trim(text), '[-+]?\\d+(?:\\.\\d+)?') AS n FROM rq),
v AS (SELECT id, CASE upper(g.b) WHEN 'S' THEN -abs(TRY_CAST(g.a AS DOUBLE)) WHEN 'N' THEN abs(TRY_CAST(g.a AS DOUBLE)) ELSE TRY_CAST(g.a AS DOUBLE) END AS la,
  CASE upper(g.d) WHEN 'W' THEN -abs(TRY_CAST(g.c AS DOUBLE)) WHEN 'E' THEN abs(TRY_CAST(g.c AS DOUBLE)) ELSE TRY_CAST(g.c AS DOUBLE) END AS lo, TRY_CAST(n[1] AS DOUBLE) AS l2, TRY_CAST(n[2] AS DOUBLE) AS o2 FROM g),
w AS (SELECT id, la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AS k1, l2 BETWEEN -90 AND 90 AND o2 BETWEEN -180 AND 180 AS k2, la, lo, l2, o2 FROM v)
SELECT id, CASE WHEN coalesce(k1, false) THEN la WHEN k2 THEN l2 END AS lat, CASE WHEN coalesce(k1, false) THEN lo WHEN k2 THEN o2 END AS lon FROM w""")
def txt_13(t: Tables):
    c = T.parse_coordinates(F.col("text"))
    return requests(t).select("id", c.alias("c")).select("id", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))


@query("win_11_trim_history", """
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM messages) z WHERE k <= 50""")
def win_11(t: Tables):
    return T.trim_history(t.messages).select("conv_id", "turn")


# Vocabulary from the benchmark texts: every distinct word, weighted by its length; words of eleven letters or
# more stand for the unrelated subjects.
_VOC = """
vw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark),
vocab AS (SELECT word, CASE length(word) % 3 WHEN 0 THEN 1E0 WHEN 1 THEN 0.85E0 ELSE 0.45E0 END AS weight, length(word) >= 11 AS off FROM vw)"""


def vocabulary(t: Tables):
    w = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("word")).distinct()
    n = F.length("word")
    return w.select("word", F.when(n % 3 == 0, 1.0).when(n % 3 == 1, 0.85).otherwise(0.45).alias("weight"), (n >= 11).alias("off"))


@query("txt_01_score_relevance", f"""
WITH {_VOC}, tk AS (SELECT conv_id, turn, regexp_extract_all(replace(lower(text), 'no 2', 'no2'), '[a-z0-9₂µ]+') AS t, lower(trim(text)) AS low FROM messages),
ds AS (SELECT DISTINCT unnest(t) AS token FROM tk),
sc AS (SELECT token, max(CASE WHEN NOT off AND s >= 0.8 THEN s * weight END) AS d, max(CASE WHEN off AND s >= 0.85 THEN s END) AS o
  FROM (SELECT token, weight, off, CASE WHEN token = word THEN 1 WHEN length(token) < 4 THEN 0 ELSE 1 - levenshtein(token, word) / CAST(greatest(length(token), length(word)) AS DOUBLE) END AS s
        FROM ds JOIN vocab ON abs(length(token) - length(word)) <= 4) z GROUP BY 1),
ex AS (SELECT conv_id, turn, unnest(t) AS token FROM tk),
ag AS (SELECT conv_id, turn, 1 - product(1 - coalesce(d, 0)) AS d, 1 - product(1 - coalesce(o, 0)) AS o FROM ex LEFT JOIN sc USING (token) GROUP BY 1, 2),
fl AS (SELECT tk.conv_id, tk.turn, CASE WHEN tk.turn > 0 AND (len(t) <= 5 OR regexp_matches(low, '^(why|how|what about|and|so|then|really|explain|more|elaborate|is that|what does that)\\b'))
   THEN greatest(coalesce(d, 0), 0.6E0) ELSE coalesce(d, 0) END AS d, coalesce(o, 0) AS o, list_has_any(t, ['no₂', 'no2', 'nox']) AS direct FROM tk LEFT JOIN ag USING (conv_id, turn)),
f2 AS (SELECT conv_id, turn, CASE WHEN direct THEN 1 ELSE d END AS d, CASE WHEN direct THEN 0 ELSE o END AS o FROM fl)
SELECT conv_id, turn, round(d, 3) AS domain, round(o, 3) AS off, round(least(d, 1 - o), 3) AS score, least(d, 1 - o) >= 0.5 AS on_topic FROM f2""")
def txt_01(t: Tables):
    return T.score_relevance(t.messages, vocabulary(t), has_history=F.col("turn") > 0)


@query("txt_04_grounded", """
WITH nm AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(replace(text, ',', ''), '[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE))) AS xs FROM texts),
fx AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS a FROM texts UNION SELECT doc_id, n_chars / 10E0 FROM texts UNION SELECT doc_id, CAST(quality * 500 AS DOUBLE) FROM labels
  UNION SELECT doc_id, unnest([0E0, 1, 2, 2.5, 3, 4, 5, 6, 7, 12, 24, 25, 30, 40, 80, 100, 180, 250]) FROM texts),
e AS (SELECT doc_id, unnest(xs) AS x FROM nm),
b AS (SELECT doc_id, count(*) AS bad FROM e WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.doc_id = e.doc_id AND x BETWEEN a - greatest(1, 0.02E0 * a) AND a + greatest(1, 0.02E0 * a)) GROUP BY 1)
SELECT doc_id, CAST(len(xs) AS INT) AS numbers, coalesce(bad, 0) AS ungrounded, bad IS NULL AS grounded FROM nm LEFT JOIN b USING (doc_id)""")
def txt_04(t: Tables):
    n = F.col("n_chars").cast("double")
    facts = (t.texts.select("doc_id", n.alias("value")).unionByName(t.texts.select("doc_id", (n / 10.0).alias("value")))
             .unionByName(t.labels.select("doc_id", (F.col("quality") * 500).cast("double").alias("value"))))
    return T.grounded(t.texts, facts)


# Facts per area and day for the decision rules.
_FACTS = _SUM + """,
fa AS (SELECT area_id, day, mean, CASE WHEN mean > 180 THEN 'critical_spike' WHEN mean > 80 THEN 'critical' WHEN mean > 40 OR share_above_naaqs >= 0.05 THEN 'elevated' ELSE 'normal' END AS status,
  round((mean - 80) / 80 * 100, 6) AS pct_vs_naaqs, CASE WHEN p95 > 160 THEN ['exceedance', 'spike'] WHEN p95 > 140 THEN ['spike'] ELSE [] END AS kinds,
  CASE WHEN median > 78 THEN ['persisting'] WHEN median > 70 THEN ['exceedance_expected'] ELSE ['no_exceedance'] END AS alert_codes,
  CASE WHEN median > 78 THEN ['critical'] WHEN median > 70 THEN ['warning'] ELSE ['info'] END AS alert_levels, CASE WHEN p95 > 140 THEN 1 ELSE 0 END AS n_anomalies,
  CASE WHEN median > mean + 5 THEN 'rising' WHEN median < mean - 5 THEN 'falling' ELSE 'stable' END AS trend,
  CASE WHEN share_normal < 0.2 THEN 'dense' WHEN share_normal < 0.25 THEN 'moderate' WHEN share_normal < 0.3 THEN 'clear' END AS haze_class, share_moderate * 40 AS wind_ms FROM s)"""


def facts(t: Tables):
    s = X.area_summary(t.cells, t.grids)
    m, md, p = F.col("mean"), F.col("median"), F.col("p95")
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    n = F.col("share_normal")
    return s.select(
        "area_id", "day", "mean", "status", r("pct_vs_naaqs").alias("pct_vs_naaqs"),
        F.when(p > 160, arr("exceedance", "spike")).when(p > 140, arr("spike")).otherwise(F.array().cast("array<string>")).alias("kinds"),
        F.when(md > 78, arr("persisting")).when(md > 70, arr("exceedance_expected")).otherwise(arr("no_exceedance")).alias("alert_codes"),
        F.when(md > 78, arr("critical")).when(md > 70, arr("warning")).otherwise(arr("info")).alias("alert_levels"),
        F.when(p > 140, 1).otherwise(0).alias("n_anomalies"), T.forecast_direction(m, md).alias("trend"),
        F.when(n < 0.2, "dense").when(n < 0.25, "moderate").when(n < 0.3, "clear").alias("haze_class"), (F.col("share_moderate") * 40).alias("wind_ms"))


@query("txt_05_detect_triggers", f"""
WITH {_FACTS} SELECT area_id, day, list_filter([CASE WHEN pct_vs_naaqs > 0 THEN 'cpcb_exceedance' END, CASE WHEN status IN ('critical', 'critical_spike') THEN 'hazardous_hotspot' END,
 CASE WHEN n_anomalies > 0 THEN 'anomaly_detected' END, CASE WHEN list_contains(alert_levels, 'critical') THEN 'critical_forecast' END, CASE WHEN list_contains(alert_codes, 'exceedance_expected') THEN 'exceedance_forecast' END,
 CASE WHEN pct_vs_naaqs > 0 OR status IN ('critical', 'critical_spike') THEN 'auto_report_triggered' END], lambda x: x IS NOT NULL) AS triggers FROM fa""")
def txt_05(t: Tables):
    return T.detect_triggers(facts(t)).select("area_id", "day", "triggers")


_COMP = _FACTS + """,
cm AS (SELECT *, CASE WHEN mean > 180 THEN 'hazardous' WHEN mean > 80 THEN 'critical' WHEN mean > 40 THEN 'elevated' ELSE 'normal' END AS severity,
  list_contains(kinds, 'exceedance') AS ex, list_contains(kinds, 'spike') AS sp, list_contains(alert_codes, 'persisting') AS pe, list_contains(alert_codes, 'exceedance_expected') AS ee FROM fa),
cc AS (SELECT *, CASE WHEN severity = 'hazardous' OR (ex AND pe) THEN 'hazardous' WHEN ex OR sp OR ee THEN 'investigation' ELSE 'advisory' END AS classification FROM cm)"""


@query("txt_06_compliance", f"""
WITH {_COMP} SELECT area_id, day, severity, classification, CASE WHEN ex THEN 'EXCEEDED' WHEN ee THEN 'AT RISK' ELSE 'WITHIN LIMITS' END AS cpcb_status,
 CASE WHEN severity = 'normal' THEN 'WITHIN LIMITS' ELSE 'EXCEEDED' END AS who_status,
 CASE classification WHEN 'hazardous' THEN ['health_advisory', 'notify_board', 'restrict_emissions', 'alert_hospitals']
  WHEN 'investigation' THEN list_filter(['field_inspection', 'check_permits', CASE WHEN sp THEN 'investigate_unlisted' END, CASE WHEN ee THEN 'preposition_monitors' END], lambda x: x IS NOT NULL)
  ELSE list_filter(['routine_monitoring', CASE WHEN trend = 'rising' THEN 'increase_frequency' END], lambda x: x IS NOT NULL) END AS actions, trend FROM cc""")
def txt_06(t: Tables):
    return T.compliance(facts(t)).select("area_id", "day", "severity", "classification", "cpcb_status", "who_status", "actions", "trend")


@query("txt_07_risk_level", f"""
WITH {_COMP} SELECT area_id, day, CASE WHEN classification = 'hazardous' THEN 'critical' WHEN classification = 'investigation' THEN 'high' WHEN severity IN ('critical', 'hazardous') THEN 'high'
 WHEN severity = 'elevated' OR trend = 'rising' THEN 'moderate' ELSE 'low' END AS risk FROM cc""")
def txt_07(t: Tables):
    return T.compliance(facts(t)).select("area_id", "day", T.risk_level(F.col("classification"), F.col("severity"), F.col("trend")).alias("risk"))


@query("txt_08_haze_combo", f"""
WITH {_FACTS} SELECT area_id, day, CASE WHEN haze_class IS NOT NULL THEN concat('haze_', CASE WHEN haze_class IN ('moderate', 'dense') THEN 'high' ELSE 'low' END, '_no2_',
 CASE WHEN status <> 'normal' OR n_anomalies > 0 THEN 'high' ELSE 'low' END) END AS combo FROM fa""")
def txt_08(t: Tables):
    return facts(t).select("area_id", "day", T.haze_combo(F.col("haze_class"), F.col("status"), F.col("n_anomalies")).alias("combo"))


@query("txt_10_agreement_label", """
WITH x AS (SELECT area_id, day, row, col, no2 * 1.3E0 AS m FROM cells), d AS (SELECT *, CASE WHEN m > 120 THEN round_even(least(8.5E0, m * 0.06E0), 1) ELSE round_even(greatest(2.1E0, m * 0.04E0), 1) END AS dis FROM x),
c AS (SELECT *, CASE WHEN m > 120 THEN round_even(greatest(0.88E0, 1 - dis / m), 2) ELSE round_even(least(0.97E0, 1 - dis / (m + 10)), 2) END AS conf FROM d)
SELECT area_id, day, row, col, dis AS disagreement, conf AS confidence, concat(CASE WHEN conf >= 0.9 THEN 'High (' ELSE 'Moderate (' END, CAST(CAST(floor(conf * 100 + 1e-9) AS INT) AS VARCHAR), '%)') AS label FROM c""")
def txt_10(t: Tables):
    return t.cells.select("area_id", "day", "row", "col", T.agreement(F.col("no2") * 1.3).alias("a")).select("area_id", "day", "row", "col", "a.*")


def _flight_inputs(t: Tables):
    sites = t.points.select(F.col("point_id").alias("site_id"), "area_id", "lat", "lon", (F.col("point_id") % 13).cast("double").alias("wind_ms"),
                            (F.col("point_id") % 360).cast("double").alias("wind_from"),
                            F.when(F.col("point_id") % 11 == 0, "dense").otherwise("clear").alias("haze_class"))
    bases = t.grids.select("area_id", (F.col("north") - 0.2).alias("lat"), (F.col("west") + 0.15).alias("lon"))
    return sites, bases, t.pois.where("category = 'FACTORY'").select("lat", "lon")


def _hm(a, b, c, d):
    return f"(12742000E0 * asin(least(1, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def _plan_steps(k: str = "") -> str:
    """Steps from the sites and bases of ``si`` to the plans of ``pi``; ``k`` ends the names of one round of flights."""
    return f"""
rt{k} AS (SELECT site_id, bla + (lat - bla) * k / 20E0 AS rla, blo + (lon - blo) * k / 20E0 AS rlo FROM si{k}, (SELECT unnest(range(21)) AS k) z),
na{k} AS (SELECT site_id, min({_hm('rla', 'rlo', 'q.lat', 'q.lon')}) / 1000 AS km FROM rt{k}, pois q WHERE q.category = 'FACTORY' AND abs(q.lat - rla) < 0.2 AND abs(q.lon - rlo) < 0.2 GROUP BY 1),
f1{k} AS (SELECT si{k}.*, {_hm('bla', 'blo', 'lat', 'lon')} AS d, (degrees(atan2(sin(radians(lon - blo)) * cos(radians(lat)), cos(radians(bla)) * sin(radians(lat)) - sin(radians(bla)) * cos(radians(lat)) * cos(radians(lon - blo)))) + 360) % 360 AS tr,
   CASE WHEN km < 12 THEN km END AS km FROM si{k} LEFT JOIN na{k} USING (site_id)),
f2{k} AS (SELECT *, w * cos(radians(wf - tr)) AS ho, w * sin(radians(wf - tr)) AS co, CASE WHEN km < 8 THEN 'yellow' WHEN km < 12 THEN 'yellow_8_12' ELSE 'green' END AS zone FROM f1{k}),
f3{k} AS (SELECT *, greatest(2, sqrt(greatest(100 - co * co, 0)) - ho) AS go, greatest(2, sqrt(greatest(100 - co * co, 0)) + ho) AS gb, CASE WHEN zone = 'yellow_8_12' THEN 60E0 ELSE 80E0 END AS agl FROM f2{k}),
ph{k} AS (SELECT *, [agl / 3, d / go, greatest(0, agl - 50) / 2, 2 * pi() * 150 * 2 / 10 * 1.15E0, greatest(0, agl - 50) / 3, d / gb, agl / 2 + 20] AS ts,
   [209E0 + 1.6E0 * 9.81E0 * 3 / 0.6E0, 161.5E0 * (1 + 0.02E0 * greatest(ho, 0)), 152E0, 180.5E0, 209E0 + 1.6E0 * 9.81E0 * 3 / 0.6E0, 161.5E0 * (1 + 0.02E0 * greatest(-ho, 0)), 152E0] AS ws FROM f3{k}),
pl{k} AS (SELECT *, list_sum(list_transform(ts, lambda x: round_even(x, 0))) AS total_s, list_sum(list_transform(range(1, 8), lambda i: round_even(ws[i] * ts[i] / 3600 / 14.8E0 * 1000, 0))) AS mah FROM ph{k}),
pi{k} AS (SELECT *, 100 * (1 - mah / 5000) AS rem, list_filter([CASE WHEN w > 10 THEN 'wind' END, CASE WHEN mah > 4000 THEN 'battery' END, CASE WHEN zone = 'yellow' THEN 'airspace' END, CASE WHEN hazy THEN 'visibility' END], lambda x: x IS NOT NULL) AS issues FROM pl{k})"""


_PLANS = f"""
si AS (SELECT point_id AS site_id, area_id, lat, lon, CAST(point_id % 13 AS DOUBLE) AS w, CAST(point_id % 360 AS DOUBLE) AS wf, point_id % 11 = 0 AS hazy, north - 0.2E0 AS bla, west + 0.15E0 AS blo FROM points JOIN grids USING (area_id)),{_plan_steps()}"""
#: Flights of the sites out of reach, again from 3 km before them.
_FORWARD = f"""
si_again AS (SELECT site_id, area_id, lat, lon, w, wf, hazy, lat + (bla - lat) * (3 / (d / 1000)) AS bla, lon + (blo - lon) * (3 / (d / 1000)) AS blo
             FROM pi WHERE list_contains(issues, 'battery') AND d / 1000 > 3),{_plan_steps("_again")}"""


@query("txt_09_inspection_plans", f"""
WITH {_PLANS} SELECT site_id, round(d / 1000, 6) AS distance_km, round(tr, 6) AS bearing, round(ho, 6) + 0 AS headwind_out, zone, round(km, 6) AS airport_km, total_s, mah AS total_mah, round(rem, 6) AS remaining_pct, issues,
 CASE WHEN len(issues) = 0 THEN 'go' WHEN list_contains(issues, 'wind') OR list_contains(issues, 'battery') THEN 'no_go' ELSE 'conditional' END AS decision FROM pi""")
def txt_09(t: Tables):
    p = T.inspection_plans(*_flight_inputs(t))
    return rr(p.select("site_id", "distance_km", "bearing", "headwind_out", "zone", "airport_km", "total_s", "total_mah", "remaining_pct", "issues", "decision"))


@query("txt_09_forward_plans", f"""
WITH {_PLANS}, {_FORWARD}, ag AS (SELECT site_id, mah, bla, blo,
 CASE WHEN len(issues) = 0 THEN 'go' WHEN list_contains(issues, 'wind') OR list_contains(issues, 'battery') THEN 'no_go' ELSE 'conditional' END AS decision FROM pi_again)
SELECT site_id, pi.issues, ag.decision AS forward_decision, ag.mah AS forward_mah, round(ag.bla, 6) AS forward_lat, round(ag.blo, 6) AS forward_lon FROM pi LEFT JOIN ag USING (site_id)""")
def txt_09b(t: Tables):
    p = T.inspection_plans(*_flight_inputs(t))
    return rr(p.select("site_id", "issues", "forward_decision", "forward_mah", "forward_lat", "forward_lon"))


@query("txt_11_deployment_decision", f"""
WITH {_PLANS}, {_COMP}, pa AS (SELECT area_id, bool_and(zone <> 'yellow') AS aok, bool_and(rem >= 15) AS bok FROM pi GROUP BY 1),
j AS (SELECT cc.*, coalesce(aok, true) AS aok, coalesce(bok, true) AS bok, wind_ms <= 10 AS wok, coalesce(haze_class <> 'dense', true) AS vok, classification <> 'advisory' AND n_anomalies > 0 AS needed FROM cc LEFT JOIN pa USING (area_id))
SELECT area_id, day, needed, needed AND aok AND bok AND wok AND vok AS deploy, CASE WHEN needed THEN list_filter([CASE WHEN NOT wok THEN 'wind' END, CASE WHEN NOT vok THEN 'visibility' END, CASE WHEN NOT aok THEN 'airspace' END,
 CASE WHEN NOT bok THEN 'battery' END], lambda x: x IS NOT NULL) ELSE ['not_needed'] END AS reasons FROM j""")
def txt_11(t: Tables):
    d = T.deployment_decision(T.compliance(facts(t)), T.inspection_plans(*_flight_inputs(t)))
    return d.select("area_id", "day", "needed", "deploy", "reasons")
