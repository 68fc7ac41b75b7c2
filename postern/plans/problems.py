"""Queries of the general data problems: repeated deliveries, nested records, timestamps."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.operators import instants, nested, upsert
from postern.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return upsert.duplicate_deliveries(table(spark, d, "cases"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The cases that remain, whole rows."""
    cases = table(spark, d, "cases")
    return cases.select("case_no", "id", "messageid", "evidencehash", "batch_id").join(upsert.duplicate_deliveries(cases), "case_no", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.case_children(table(spark, d, "cases"))


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = nested.node_table(nested.case_tree(table(spark, d, "cases"), full=True), "case_no", "candidate")
    return n.select("case_no", "pre", "post", "pos", F.col("leaf").alias("ip"), F.col("attrs.scope").alias("scope"), F.col("attrs.origin").alias("origin"), F.col("attrs.isprimary").alias("isprimary"))


def p5_sightings(spark: SparkSession, d: str) -> DataFrame:
    n = nested.contained(nested.case_tree(table(spark, d, "cases"), full=True), "case_no", "candidate", "sighting")
    return n.select("case_no", "parent_pre", "pre", "post", "pos", F.col("leaf").alias("feed"), F.col("attrs.seenat").cast("bigint").alias("seenat"), F.col("attrs.tags").alias("tags"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    n = nested.node_table(nested.case_tree(table(spark, d, "cases")), "case_no", "member")
    return n.select("case_no", "pre", "post", "pos", F.col("leaf").alias("member"))


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    values = instants.mail_times(table(spark, d, "messages"), table(spark, d, "hops"))
    return instants.normalise(values, table(spark, d, "relay_sites"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_instants(spark, d).select("src", "rec_no", "utc_ms")


QUERIES = {f.__name__: f for f in (p3_found, p3_kept, p5_found, p5_candidates, p5_sightings, p5_members, p6_found, p6_instants)}

_KEY = "lower(trim(evidencehash)) || '|' || lower(regexp_replace(coalesce(messageid, ''), '^[\\s<>]+|[\\s<>]+$', '', 'g'))"

_TEXT = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN TRY_CAST({x} ->> '$' AS JSON) ELSE {x} END"
_ITEMS = lambda x: f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] END"
_NODES = f"""WITH j AS (SELECT case_no, {_TEXT('t')} AS t FROM (SELECT case_no, TRY_CAST(attributionraw AS JSON) AS t FROM cases WHERE attribution IS NULL AND attributionraw IS NOT NULL)),
    k AS (SELECT case_no, {_TEXT('a')} AS a FROM (SELECT case_no, coalesce(CASE WHEN json_type(t -> '$.attribution') <> 'NULL' THEN t -> '$.attribution' END, t) AS a FROM j)), l AS (SELECT case_no, {_TEXT('c')} AS c FROM (SELECT case_no, a -> '$.candidates' AS c FROM k)),
    m AS (SELECT case_no, {_ITEMS('c')} AS items FROM l), raw AS (SELECT case_no, unnest(items) AS c, unnest(range(len(items))) AS pos FROM m),
    st AS (SELECT case_no, unnest(attribution.candidates) AS c, unnest(range(len(attribution.candidates))) AS pos FROM cases WHERE attribution IS NOT NULL),
    cand AS (SELECT case_no, pos, coalesce(c.ip, '') AS ip, c.scope AS scope, c.origin AS origin, CAST(c.isprimary AS VARCHAR) AS isprimary, [CASE WHEN s IS NOT NULL THEN {{'feed': coalesce(s.feed, ''), 'seenat': s.seenat, 'tags': CAST(to_json(s.tags) AS VARCHAR)}} END FOR s IN c.sightings] AS feeds FROM st WHERE c IS NOT NULL
        UNION ALL SELECT case_no, pos, coalesce(c ->> '$.ip', ''), c ->> '$.scope', c ->> '$.origin', CASE WHEN lower(c ->> '$.isprimary') IN ('true', 'false') THEN lower(c ->> '$.isprimary') END,
            [CASE WHEN json_type(s) <> 'NULL' THEN {{'feed': coalesce(s ->> '$.feed', ''), 'seenat': TRY_CAST(s ->> '$.seenat' AS BIGINT), 'tags': CASE WHEN json_type(s -> '$.tags') = 'ARRAY' THEN CAST(s -> '$.tags' AS VARCHAR) END}} END FOR s IN {_ITEMS("(c -> '$.sightings')")}] FROM raw WHERE json_type(c) <> 'NULL'),
    sized AS (SELECT *, coalesce(len(list_filter(feeds, lambda f: f IS NOT NULL)), 0) AS kids FROM cand),
    placed AS (SELECT *, 1 + coalesce(sum(1 + kids) OVER (PARTITION BY case_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM sized),
    sight AS (SELECT case_no, pos AS up, pre AS parent_pre, f, i, row_number() OVER (PARTITION BY case_no, pos ORDER BY i) AS k FROM (SELECT case_no, pos, pre, unnest(feeds) AS f, unnest(range(len(feeds))) AS i FROM placed) WHERE f IS NOT NULL),
    mem AS (SELECT case_no, v, i, row_number() OVER (PARTITION BY case_no ORDER BY i) AS k FROM (SELECT case_no, unnest(members) AS v, unnest(range(len(members))) AS i FROM cases) WHERE v IS NOT NULL)"""

def _instants_sql() -> str:
    """Problem 6 in SQL: the patterns are the operator's, the rest is written again. A source's order is the one with more evidence, to which the fit converges."""
    fields = []
    for name, (pattern, to) in instants.PATTERNS.items():
        groups = [f"regexp_extract(t, '{pattern.replace(chr(39), chr(39) * 2)}', {x[1:]})" if x else "''" for x in to.split("|")]
        fields.append(f"WHEN family = '{name}' AND regexp_matches(t, '{pattern.replace(chr(39), chr(39) * 2)}') THEN [{', '.join(groups)}]")
    zones = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    known = "CASE upper(zone) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in instants.ABBREVIATIONS.items()) + " END"
    day = lambda m, d: f"(y BETWEEN 1 AND 9999 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND CASE WHEN y BETWEEN 1 AND 9999 AND {m} BETWEEN 1 AND 12 THEN {d} <= day(last_day(make_date(y, {m}, 1))) END)"
    return f"""WITH v AS (SELECT 'messages' AS src, msg_no AS rec_no, originhost AS host, dateheader AS value FROM messages UNION ALL SELECT 'hops', hop_no, byhost, timestampraw FROM hops),
    t AS (SELECT *, trim(CASE WHEN contains(value, '(') THEN regexp_replace(value, '\\([^()]*\\)', ' ', 'g') ELSE value END, ' ') AS t FROM v),
    f AS (SELECT *, CASE WHEN regexp_matches(t, '^\\d{{9,17}}$') AND length(t) <> 14 THEN 'epoch' WHEN t[2] = '/' OR t[3] = '/' THEN 'slash' WHEN t[2] = '.' OR t[3] = '.' THEN 'dotted' WHEN t[5] = '-' THEN 'iso' WHEN regexp_matches(t, '^\\d{{8}}') THEN 'compact'
        WHEN regexp_matches(t, '^[A-Za-z]{{3,9}},?\\s+[A-Za-z]') THEN 'asctime' ELSE 'rfc' END AS family FROM t WHERE t IS NOT NULL),
    g AS (SELECT *, CASE {' '.join(fields)} END AS p FROM f),
    n AS (SELECT *, TRY_CAST(p[1] AS INTEGER) + CASE WHEN length(p[1]) = 2 THEN 2000 ELSE 0 END AS y, CASE WHEN regexp_matches(p[2], '^[A-Za-z]') THEN nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(p[2])), 0) ELSE TRY_CAST(p[2] AS INTEGER) END AS a, TRY_CAST(p[3] AS INTEGER) AS b,
        CASE WHEN p[9] = '' THEN TRY_CAST(p[4] AS INTEGER) WHEN TRY_CAST(p[4] AS INTEGER) BETWEEN 1 AND 12 THEN TRY_CAST(p[4] AS INTEGER) % 12 + CASE WHEN upper(p[9]) = 'PM' THEN 12 ELSE 0 END END AS h, TRY_CAST(p[5] AS INTEGER) AS mi,
        CASE WHEN p[6] = '' THEN 0 ELSE TRY_CAST(p[6] AS INTEGER) END AS s, CASE WHEN p[7] = '' THEN 0 ELSE TRY_CAST(rpad(p[7], 3, '0')[1:3] AS INTEGER) END AS ms, p[8] AS zone FROM g),
    c AS (SELECT *, h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 60 AS clock_ok, coalesce({day('a', 'b')}, false) AS dmy, coalesce(family = 'slash' AND {day('b', 'a')}, false) AS mdy FROM n),
    o AS (SELECT src, host, count(*) FILTER (WHERE dmy AND NOT mdy) AS nd, count(*) FILTER (WHERE mdy AND NOT dmy) AS nm FROM c WHERE family = 'slash' AND clock_ok AND host IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT c.*, clockzone, mdy AND (NOT dmy OR coalesce(nd, 0) + CASE WHEN lower(dayorder) = 'dmy' THEN 50 ELSE 1 END < coalesce(nm, 0) + CASE WHEN lower(dayorder) = 'mdy' THEN 50 ELSE 1 END) AS swap FROM c LEFT JOIN o USING (src, host) LEFT JOIN relay_sites r ON r.byhost = c.host),
    l AS (SELECT *, CASE WHEN clock_ok AND (dmy OR mdy) THEN make_timestamp(y, CASE WHEN swap THEN b ELSE a END, CASE WHEN swap THEN a ELSE b END, 0, 0, 0) + to_seconds(h * 3600 + mi * 60 + s) END AS ts, CASE WHEN zone = '' THEN clockzone WHEN zone[1] = '[' THEN zone[2:-2] END AS named,
        CASE WHEN regexp_matches(zone, '^[+-]') THEN CAST(replace(zone, ':', '')[2:3] AS INTEGER) * 60 + CAST(replace(zone, ':', '')[4:5] AS INTEGER) END AS minutes FROM w),
    z AS (SELECT *, CASE WHEN named IN ({zones}) THEN named END AS tz, CASE WHEN minutes <= 18 * 60 THEN CASE WHEN zone[1] = '-' THEN -minutes ELSE minutes END WHEN regexp_matches(zone, '^[A-Za-z]') THEN {known} END AS off FROM l),
    q AS (SELECT *, CASE WHEN tz IS NOT NULL THEN timezone(tz, ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR END AS t1, CASE WHEN tz IS NOT NULL THEN timezone(tz, ts) END AS t2 FROM z)
    SELECT src, rec_no, CASE WHEN family = 'epoch' THEN CASE WHEN length(t) <= 11 THEN TRY_CAST(t AS BIGINT) * 1000 WHEN length(t) <= 14 THEN TRY_CAST(t AS BIGINT) ELSE TRY_CAST(t AS BIGINT) // 1000 END
        WHEN tz IS NOT NULL THEN epoch_ms(CASE WHEN timezone(tz, t1) = ts THEN least(t1, t2) WHEN timezone(tz, t2) = ts THEN t2 ELSE t1 END) + ms ELSE epoch_ms(ts) - off * 60000 + ms END AS utc_ms FROM q"""


SQL = {
    "p6_found": f"SELECT * FROM ({_instants_sql()}) WHERE utc_ms IS NOT NULL",
    "p5_found": _NODES + """ SELECT case_no, 'candidate' AS child, CAST(pos AS INTEGER) AS pos, -1 AS subpos, ip AS leaf FROM cand
        UNION ALL SELECT case_no, 'sighting', CAST(up AS INTEGER), CAST(i AS INTEGER), f.feed FROM sight UNION ALL SELECT case_no, 'member', CAST(i AS INTEGER), -1, v FROM mem""",
    "p5_candidates": _NODES + " SELECT case_no, CAST(pre AS INTEGER) AS pre, CAST(pre + kids - 1 AS INTEGER) AS post, CAST(pos AS INTEGER) AS pos, ip, scope, origin, isprimary FROM placed",
    "p5_sightings": _NODES + " SELECT case_no, CAST(parent_pre AS INTEGER) AS parent_pre, CAST(parent_pre + k AS INTEGER) AS pre, CAST(parent_pre + k - 2 AS INTEGER) AS post, CAST(i AS INTEGER) AS pos, f.feed AS feed, f.seenat AS seenat, f.tags AS tags FROM sight",
    "p5_members": _NODES + """ SELECT case_no, CAST(coalesce(n, 0) + k AS INTEGER) AS pre, CAST(coalesce(n, 0) + k - 1 AS INTEGER) AS post, CAST(i AS INTEGER) AS pos, v AS member
        FROM mem LEFT JOIN (SELECT case_no, sum(1 + kids) AS n FROM sized GROUP BY 1) USING (case_no)""",
    "p3_found": f"""
        SELECT case_no FROM (
            SELECT case_no, row_number() OVER (PARTITION BY {_KEY} ORDER BY ingestedat NULLS LAST, case_no) AS n
            FROM cases WHERE evidencehash IS NOT NULL) WHERE n > 1""",
    "p3_kept": f"""
        SELECT case_no, id, messageid, evidencehash, batch_id FROM (
            SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ingestedat NULLS LAST, case_no) AS n
            FROM cases) WHERE n = 1 OR evidencehash IS NULL""",
}
