"""Queries over raw messages and stateful operators, built from the message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions import headers, mailparse
from postern.operators import report
from postern.plans.textual import uuid5_sql
from postern.session import table
from postern.sources import files
from postern.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRIES = "(SELECT 'desk-' || CAST(user_id % 2 AS INTEGER) AS account, epoch_us(ts) // 1000 AS t, event_type = 'signup' AS ok, event_id AS seq, row_number() OVER (PARTITION BY user_id % 2 ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events)"
_WIN = "list_filter(f0, lambda x: x > t - 900000) || [t]"


@query(f"""WITH RECURSIVE ev AS MATERIALIZED {_TRIES}, st(account, i, t, ok, seq, f, until, locked) AS (SELECT DISTINCT account, CAST(0 AS BIGINT), NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT, []::BIGINT[], CAST(0 AS BIGINT), false FROM ev UNION ALL
    SELECT account, i, t, ok, seq, CASE WHEN u0 > 0 THEN f0 WHEN ok THEN [] ELSE {_WIN} END, CASE WHEN u0 > 0 THEN u0 WHEN ok THEN 0 WHEN len({_WIN}) >= 5 THEN t + 900000 ELSE 0 END, CASE WHEN u0 > 0 THEN true WHEN ok THEN false ELSE len({_WIN}) >= 5 END
    FROM (SELECT ev.account, ev.i, ev.t, ev.ok, ev.seq, CASE WHEN until > 0 AND ev.t >= until THEN [] ELSE f END AS f0, CASE WHEN until > 0 AND ev.t >= until THEN 0 ELSE until END AS u0 FROM st JOIN ev ON ev.account = st.account AND ev.i = st.i + 1))
    SELECT account, t AS ts_ms, ok, CAST(len(f) AS INTEGER) AS failures, locked, seq FROM st WHERE i > 0""")
def z02_lockout(spark: SparkSession, d: str) -> DataFrame:
    """W06's exact form: the lockout machine over all events of two desks, of which signups succeed."""
    a = table(spark, d, "events").select(F.concat(F.lit("desk-"), (F.col("user_id") % 2).cast("int").cast("string")).alias("account"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") == "signup").alias("ok"), F.col("event_id").alias("seq"))
    return stateful.lockout_batch(a)


_GRAPH = """ev AS (SELECT m.msg_no AS msg, ip, nullif(regexp_replace(lower(CASE WHEN contains(fromaddr, '<') THEN regexp_extract(fromaddr, '<([^>]*)', 1) ELSE fromaddr END), '^.*@[.-]*', ''), '') AS domain, contains(fromaddr, '@') AS ok FROM messages m LEFT JOIN (SELECT msg_no, ip FROM hops WHERE hopindex = 0) h USING (msg_no)),
    pairs AS (SELECT DISTINCT 'm' || lpad(CAST(msg AS VARCHAR), 20, '0') AS a, 'z:i:' || ip AS b FROM ev WHERE ip IS NOT NULL UNION SELECT DISTINCT 'm' || lpad(CAST(msg AS VARCHAR), 20, '0'), 'z:d:' || domain FROM ev WHERE domain IS NOT NULL AND ok),
    edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)"""


@query(f"""WITH RECURSIVE {_GRAPH}, cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM edges UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc u JOIN edges e ON e.a = u.id JOIN cc v ON v.id = e.b WHERE v.comp < u.comp ORDER BY u.id, v.comp))
    SELECT CAST(id[2:] AS BIGINT) AS msg, CAST(comp[2:] AS BIGINT) AS campaign FROM cc WHERE id LIKE 'm%'""")
def z01_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """C11 as well: messages joined by address or sender domain."""
    h = table(spark, d, "hops").filter("hopindex = 0").select("msg_no", "ip")
    m = table(spark, d, "messages").join(h, "msg_no", "left")
    return stateful.campaigns_batch(m.select(F.col("msg_no").alias("msg"), "ip", headers.address_domain("fromaddr").alias("domain")))


_ARRIVALS = f"(SELECT CAST(m.msg_no AS VARCHAR) AS msg, ip, nullif(regexp_replace(lower(fromaddr), '^.*@', ''), '') AS domain, row_number() OVER (ORDER BY epoch_us(ingestedat) NULLS FIRST, CAST(m.msg_no AS VARCHAR)) AS i FROM messages m LEFT JOIN (SELECT msg_no, arg_min(ip, hop_no) AS ip FROM hops WHERE hopindex = 0 AND ip IS NOT NULL GROUP BY 1) h USING (msg_no))"


@query(f"""WITH RECURSIVE ev AS MATERIALIZED {_ARRIVALS}, st(i, m, msg, campaign) AS (SELECT CAST(0 AS BIGINT), MAP {{'': ''}}, NULL::VARCHAR, NULL::VARCHAR UNION ALL
    SELECT i, map_concat(m, map_from_entries(list_filter([{{'k': 'i' || ip, 'v': c}}, {{'k': 'd' || domain, 'v': c}}], lambda e: e.k IS NOT NULL))), msg, c FROM (SELECT ev.i, st.m, ev.msg, ip, domain, coalesce(st.m['i' || ip], st.m['d' || domain], 'CMP-' || ev.msg) AS c FROM st JOIN ev ON ev.i = st.i + 1))
    SELECT msg, campaign FROM st WHERE msg IS NOT NULL""")
def c11_online_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Z01 as well: messages assigned in order of arrival, by the newest hop's address, else the sender's domain."""
    h = table(spark, d, "hops").filter("hopindex = 0 and ip is not null").groupBy("msg_no").agg(F.min_by("ip", "hop_no").alias("ip"))
    m = table(spark, d, "messages").join(h, "msg_no", "left")
    domain = F.regexp_replace(F.lower("fromaddr"), "^.*@", "")
    e = m.select(F.col("msg_no").cast("string").alias("msg"), F.coalesce(F.unix_micros(F.col("ingestedat").cast("timestamp")), F.lit(-(1 << 60))).alias("seq"), "ip", F.when(domain != "", domain).alias("domain"))
    return stateful.campaigns_online(e).select("msg", "campaign")


@query("""SELECT r.event_id, coalesce(bool_or(l.ts <= r.ts AND r.ts < l.ts + INTERVAL 8 HOUR), false) AS active FROM (SELECT * FROM events WHERE event_type = 'click') r
    LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') l ON l.user_id = r.user_id AND l.ts <= r.ts AND r.ts < l.ts + INTERVAL 8 HOUR GROUP BY 1""")
def z03_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("account"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_type")
    return stateful.sessions(e.filter("event_type = 'signup'"), e.filter("event_type = 'click'").select("event_id", "account", "ts_ms")).select("event_id", "active")


def _audit(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Cases with the custody of the chain that belongs to them: a chain per customer, every fifth record signed."""
    from postern.functions import ed25519
    from postern.operators import audit
    from postern.plans import analysis
    from postern.session import materialize

    lines = materialize(analysis.order_chains(spark, d).filter("key % 10 = 1"), "chains")
    s = audit.sign_heads(lines.withColumn("line", F.when(F.get_json_object("line", "$.hash").isNull(), F.lit('{"hash":"0"}')).otherwise(F.col("line"))), analysis.SEED, 5, ["key"])
    v = audit.status(lines, s, ed25519.public_key(analysis.SEED), 5, ["key"]).select((F.col("key") / 10).cast("bigint").alias("chain"), "assurance", "head_signed", "last_signed", "records")
    c = table(spark, d, "cases").withColumn("chain", F.col("case_no") % 100).join(v, "chain", "left")
    return c, {"assurance": F.col("assurance"), "head": F.lit(None).cast("string"), "head_signed": F.coalesce("head_signed", F.lit(False)), "last_signed": F.col("last_signed")}


_CHAINS = """(SELECT chain, records, last_signed, head_signed, CASE WHEN NOT ok OR (at_head AND NOT head_signed) THEN 'TAMPERED' WHEN last_signed IS NOT NULL THEN 'SIGNED' WHEN records >= 5 THEN 'TAMPERED' ELSE 'UNSIGNED' END AS assurance
    FROM (SELECT *, coalesce(ok AND at_head AND last_signed = records - 1, false) AS head_signed FROM (SELECT key // 10 AS chain, count(*) AS records, bool_and(k % 97 > 4) AS ok, max(pos) FILTER (WHERE (pos + 1) % 5 = 0 AND k % 97 <> 1) AS last_signed, count(*) % 5 = 0 AS at_head
        FROM (SELECT o_custkey AS key, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_custkey % 10 = 1) GROUP BY key)))"""
_shown = lambda e: f"coalesce(CAST({e} AS VARCHAR), 'not known')"
_list = lambda c: f"CASE WHEN {c} IS NULL THEN 'none' ELSE array_to_string(list_filter({c}, lambda v: v IS NOT NULL), ', ') END"


@query(f"""SELECT case_no, concat_ws(chr(10), 'CASE REPORT', '0. CHAIN OF CUSTODY', '  Assurance: ' || {_shown('assurance')}, '  Head hash: not known', '  Head signature valid: ' || coalesce(head_signed, false), '  Last signed record: ' || {_shown('last_signed')},
    '1. CASE SUMMARY', '  Case: ' || {_shown('id')}, '  Evidence SHA-256: ' || {_shown('evidencehash')}, '  Observed at: ' || {_shown('observedat')}, '  Verdict: ' || {_shown('verdict')}, '  Risk: ' || {_shown("printf('%.2f', riskfinal)")}, '2. SEMANTIC ANALYSIS', '  no breakdown for this record',
    '3. INFRASTRUCTURE AND CORRELATION', '  Sender domains: ' || {_list('domains')}, '  Observed addresses: ' || {_list('hopaddresses')}, '4. PROOF', CASE WHEN coalesce(head_signed, false) AND assurance = 'SIGNED' THEN '  the head of the audit log is signed by the configured key' ELSE '  not signed: the records are linked by hashes only' END) AS text, true AS is_pdf
    FROM cases LEFT JOIN {_CHAINS} ch ON ch.chain = case_no % 100""")
def k06_pdf_report(spark: SparkSession, d: str) -> DataFrame:
    """S11 as well: the report of every case, all sections, and whether it is a PDF."""
    c, a = _audit(spark, d)
    t = c.select("case_no", report.report_text(a).alias("text"))
    return t.select("case_no", "text", F.substring(report.pdf_report(F.col("text")), 1, 5).cast("string").eqNullSafe("%PDF-").alias("is_pdf"))


_STIX_ITEMS = r"""(SELECT DISTINCT case_no, type, v FROM (
    SELECT case_no, 'email-message' AS type, id AS v FROM cases WHERE id <> ''
    UNION ALL SELECT case_no, 'email-addr', v FROM (SELECT case_no, lower(trim(unnest(addresses), ' ')) AS v FROM cases) WHERE regexp_matches(v, '^[^@\s]+@[^@\s]+$')
    UNION ALL SELECT case_no, 'domain-name', v FROM (SELECT case_no, lower(trim(unnest(domains), ' ')) AS v FROM cases) WHERE length(v) <= 253 AND regexp_matches(v, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$')
    UNION ALL SELECT case_no, CASE WHEN contains(v, ':') THEN 'ipv6-addr' ELSE 'ipv4-addr' END, v FROM (SELECT case_no, lower(trim(unnest(hopaddresses), ' ')) AS v FROM cases) WHERE regexp_matches(v, '^[0-9a-f:]*:[0-9a-f:.]*$') OR regexp_matches(v, '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$')
    UNION ALL SELECT case_no, 'url', v FROM (SELECT case_no, unnest(urls) AS v FROM cases) WHERE length(v) BETWEEN 1 AND 2048
    UNION ALL SELECT case_no, 'file', v FROM (SELECT case_no, lower(trim(unnest(attachmenthashes), ' ')) AS v FROM cases) WHERE regexp_matches(v, '^[0-9a-f]{64}$')))"""


@query(f"SELECT case_no, type, v AS value, type || '--' || {uuid5_sql('type || ' + repr(':') + ' || v')} AS stix_id FROM {_STIX_ITEMS}")
def k05_case_objects(spark: SparkSession, d: str) -> DataFrame:
    """X18 as well: every observable of every case with its identifier."""
    from postern.operators import stix

    return stix.observables(table(spark, d, "cases"))


@query(f"SELECT stix_id, type, value, min(case_no) AS first_case FROM (SELECT case_no, type, v AS value, type || '--' || {uuid5_sql('type || ' + repr(':') + ' || v')} AS stix_id FROM {_STIX_ITEMS}) GROUP BY 1, 2, 3")
def k05_stix_objects(spark: SparkSession, d: str) -> DataFrame:
    """U03 as well: every observable once, by deterministic id."""
    from postern.operators import stix

    return stix.distinct_objects(stix.observables(table(spark, d, "cases")))


@query(f"""WITH o AS (SELECT case_no, type || '--' || {uuid5_sql('type || ' + repr(':') + ' || v')} AS sid FROM {_STIX_ITEMS}), b AS (SELECT case_no, string_agg(DISTINCT sid, ',' ORDER BY sid) AS ids, count(DISTINCT sid) AS n FROM o GROUP BY 1)
    SELECT case_no, 'bundle--' || {uuid5_sql('sha256(ids)')} AS bundle_id, CAST(n AS INTEGER) AS n_objects, 0 AS left_out FROM b""")
def k05_stix_bundles(spark: SparkSession, d: str) -> DataFrame:
    from postern.operators import stix

    return stix.bundles(stix.observables(table(spark, d, "cases"))).select("case_no", "bundle_id", "n_objects", "left_out")


@query(f"SELECT c.case_no, id, coalesce(n, 0) AS n_objects, assurance, evidencehash AS evidence FROM cases c LEFT JOIN (SELECT case_no, count(*) AS n FROM {_STIX_ITEMS} GROUP BY 1) o USING (case_no) LEFT JOIN {_CHAINS} ch ON ch.chain = c.case_no % 100")
def k07_json_report(spark: SparkSession, d: str) -> DataFrame:
    """The JSON report of every case, read back: case, STIX objects and audit block are in it."""
    from postern.operators import stix

    c, a = _audit(spark, d)
    per = stix.observables(table(spark, d, "cases")).groupBy("case_no").agg(F.array_sort(F.collect_list(F.struct(F.col("stix_id").alias("id"), "type", "value"))).alias("objects"))
    j = c.join(per, "case_no", "left").withColumn("objects", F.coalesce("objects", F.array().cast("array<struct<id:string,type:string,value:string>>")))
    doc = j.select("case_no", report.json_report(["id", "status", "risk", "band", "evidencehash", "domains"], F.col("objects"), a).alias("json"))
    at = lambda p: F.get_json_object("json", p)
    n = F.size(F.from_json(at("$.stix.objects"), "array<struct<id:string>>")).cast("bigint")
    return doc.select("case_no", at("$.case.id").alias("id"), n.alias("n_objects"), at("$.audit.assurance").alias("assurance"), at("$.case.evidencehash").alias("evidence"))


@query("""SELECT case_no, id, status, verdict, band, CASE WHEN length(subject) > 20 THEN substr(subject, 1, 20) || '...[truncated]' ELSE subject END AS subject, CASE WHEN observedat >= 0 THEN observedat END AS observed_ms, """ + ", ".join(f"coalesce(len({c}), 0) AS n_{c}" for c in ("domains", "urls", "addresses", "hopaddresses", "attachmenthashes", "members")) + """,
    attribution IS NOT NULL OR attributionraw IS NOT NULL AS attributed FROM cases""")
def r11_case_summaries(spark: SparkSession, d: str) -> DataFrame:
    from postern.operators import cases

    return cases.summaries(table(spark, d, "cases"), 20)


@query("SELECT case_no, json_valid(attributionraw) AS valid FROM cases WHERE attributionraw IS NOT NULL")
def s10_strict_json(spark: SparkSession, d: str) -> DataFrame:
    return files.strict_json(table(spark, d, "cases").filter("attributionraw is not null").select("case_no", "attributionraw"), "attributionraw").select("case_no", "valid")
