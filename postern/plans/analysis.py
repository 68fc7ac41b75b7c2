"""Queries of scoring, correlation, attribution, cases, audit, export and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import net, scoring, text
from postern.operators import attribution, audit, cases, correlate, enrich, evaluate, features, graph, instants, orgprofile, stix
from postern.plans.textual import _NUM, _TOKENS, SCOPE_SQL
from postern.session import let, materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the model -------------------------------------------------------------------------------

# A deterministic feature vector per order: every third position unobserved.
_VEC = "array_vector"


def order_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors derived from orders: position i is ((key * (i + 3)) % 11) / 10, unobserved where (key + i) % 3 = 0."""
    k = F.col("o_orderkey")
    x = F.array(*[scoring.quarantine(F.when((k + i) % 3 != 0, ((k * (i + 3)) % 11) / 10.0)) for i in range(60)])
    return table(spark, d, "orders").select("o_orderkey", x.alias("x"))


_X = "list_transform(range(0, 60), lambda i: CASE WHEN (o_orderkey + i) % 3 != 0 AND ((o_orderkey * (i + 3)) % 11) / 10.0 <= 1 THEN ((o_orderkey * (i + 3)) % 11) / 10.0 END)"


def _z_sql(k: int) -> str:
    w = "[" + ", ".join(repr(v) for v in scoring.weights()[k]) + "]"
    return f"{L.INTERCEPTS[k]} + list_sum(list_transform(range(1, 61), lambda i: greatest(-2.5, least(2.5, {w}[i] * coalesce(x[i], 0)))))"


_LOGITS = f"SELECT o_orderkey, x, [{', '.join(_z_sql(k) for k in range(8))}] AS z FROM (SELECT o_orderkey, {_X} AS x FROM orders)"
_PROBS = f"SELECT o_orderkey, x, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS p FROM ({_LOGITS})"
_BEC = "1 / (1 + exp(-(" + f"{L.BEC_INTERCEPT} + " + " + ".join(f"{g} * coalesce(x[{L.FEATURES.index(n) + 1}], 0)" for n, g in L.BEC_WEIGHTS.items()) + ")))"
_RF = f"100 * (1 - p[1] * (1 - {L.W_BEC} * bec))"
_CONF = "pow(greatest(0, 1 - list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END)) / ln(8)), 0.7)"
_SCORED = f"SELECT *, {_RF} AS rf, {_CONF} AS conf FROM (SELECT *, {_BEC} AS bec FROM ({_PROBS}))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(order_vectors(spark, d))


@query(f"SELECT o_orderkey, round(z[1], 6) AS z_legitimate, round(z[5], 6) AS z_bec, round(z[8], 6) AS z_spam FROM ({_LOGITS})")
def m01_logits(spark: SparkSession, d: str) -> DataFrame:
    """M11 as well: the weights are the family weights shared by each family's features."""
    return scored(spark, d).select("o_orderkey", *[F.round(F.get("z", F.lit(i)), 6).alias(n) for i, n in ((0, "z_legitimate"), (4, "z_bec"), (7, "z_spam"))])


@query(f"SELECT o_orderkey, round(p[1], 6) AS p_legitimate, round(p[4], 6) AS p_phishing, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top FROM ({_PROBS})")
def m02_softmax(spark: SparkSession, d: str) -> DataFrame:
    """X25 and L05 as well."""
    return scored(spark, d).select("o_orderkey", F.round(F.get("p", F.lit(0)), 6).alias("p_legitimate"), F.round(F.get("p", F.lit(3)), 6).alias("p_phishing"), "top")


@query(f"""SELECT o_orderkey, round(100 * (1 - p[1]), 6) AS risk, round(bec, 6) AS bec, round(rf, 6) AS risk_final, round(conf, 6) AS confidence,
    CASE WHEN rf >= 60 THEN 'HIGH-RISK' WHEN rf >= 40 THEN 'SUSPICIOUS' ELSE 'LOW' END AS band,
    CASE WHEN conf < 0.5 THEN 'UNDETERMINED' WHEN conf < 0.7 THEN 'LOW_CONFIDENCE_REVIEW_ADVISED' ELSE 'DETERMINED' END AS verdict FROM ({_SCORED})""")
def m06_score(spark: SparkSession, d: str) -> DataFrame:
    """M03, M04, M05, M07, M09, R08, R09 and X26, X27 as well."""
    return scored(spark, d).select(
        "o_orderkey", *[F.round(c, 6).alias(c) for c in ("risk", "bec", "risk_final", "confidence")], "band", "verdict",
    )


@query("""SELECT l_orderkey, round(1 - list_product(list_transform(list(l_discount), lambda v: 1 - v)), 6) AS any_of FROM lineitem GROUP BY 1""")
def m05_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("v"))
    return g.select("l_orderkey", F.round(scoring.noisy_or("v"), 6).alias("any_of"))


@query("""SELECT l_orderkey, l_linenumber, round(least(0.85, pow(t, 0.35) * pow(s, 0.25) * pow(1 - a, 0.25) * pow(x, 0.15)), 6) AS value FROM (
    SELECT l_orderkey, l_linenumber, l_quantity / 50 AS t, l_discount * 10 AS s, l_tax * 10 AS a, (l_quantity % 5) / 4 AS x FROM lineitem)""")
def m08_attribution_confidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    v = scoring.geometric_confidence(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, (F.col("l_quantity") % 5) / 4)
    return li.select("l_orderkey", "l_linenumber", F.round(v, 6).alias("value"))


_FEATURE_NAMES = "[" + ", ".join(repr(f) for f in L.FEATURES) + "]"


@query(f"""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY -abs(c), pos) - 1 AS INTEGER) AS rank, feature, round(c, 6) + 0 AS contribution FROM (SELECT o_orderkey, unnest({_FEATURE_NAMES}) AS feature, unnest(range(60)) AS pos,
    unnest(list_transform(range(1, 61), lambda i: greatest(-2.5, least(2.5, ([{', '.join('[' + ', '.join(map(repr, w)) + ']' for w in scoring.weights())}][k])[i] * coalesce(x[i], 0))))) AS c FROM (SELECT o_orderkey, x, list_position(z, list_max(z)) AS k FROM ({_LOGITS}))) WHERE c <> 0""")
def m10_findings(spark: SparkSession, d: str) -> DataFrame:
    """W07 as well: clipped terms of the chosen class, strongest first."""
    f = scored(spark, d).select("o_orderkey", F.posexplode(scoring.findings("x", "top")).alias("rank", "f"))
    names = F.array(*[F.lit(x) for x in L.FEATURES])
    return f.select("o_orderkey", "rank", F.get(names, F.col("f.pos")).alias("feature"), F.round("f.contribution", 6).alias("contribution"))


@query(f"""SELECT family, round(sum(v), 6) AS total, count(*) AS n FROM (SELECT (i - 1) AS i, greatest(-2.5, least(2.5, [{', '.join(repr(v) for v in scoring.weights()[3])}][i] * coalesce(x[i], 0))) AS v,
    [{', '.join(repr(list(L.FAMILIES)[f]) for f in scoring.family_index())}][i] AS family FROM (SELECT {_X} AS x FROM orders), range(1, 61) AS r(i)) GROUP BY family""")
def a09_family_totals(spark: SparkSession, d: str) -> DataFrame:
    """Contribution of each feature family to one class over all rows; families without any contribution stay."""
    fam = list(L.FAMILIES)
    w = F.array(*[F.lit(v) for v in scoring.weights()[3]])
    terms = F.transform(F.zip_with(w, F.col("x"), scoring.term), lambda v, i: F.struct(v.alias("v"), F.get(F.array(*[F.lit(fam[f]) for f in scoring.family_index()]), i).alias("family")))
    e = order_vectors(spark, d).select(F.explode(terms).alias("t"))
    return e.groupBy("t.family").agg(F.round(F.sum("t.v"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, len(list_filter(x, lambda v: v IS NOT NULL)) AS observed, 60 - len(list_filter(x, lambda v: v IS NOT NULL)) AS unobserved FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def a11_observed(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("x", lambda v: v.isNotNull())).cast("bigint")
    return order_vectors(spark, d).select("o_orderkey", n.alias("observed"), (60 - n).alias("unobserved"))


def _lex_sql(lex) -> str:
    from postern.plans.textual import _weighted_sql

    return f"least(1, ({_weighted_sql('t', lex)[6:-4]}) / 1.5)"


def _cue_sql(cues) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{x}') AS INTEGER)" for x in cues) + ")"


@query(f"""SELECT part_no, round({_lex_sql(L.URGENCY)}, 6) AS urgency, round(least(1, {_cue_sql(L.CHANNEL_CHANGE)} / 2.0), 6) AS channel_change,
    CASE WHEN {_cue_sql(L.PAYMENT)} <= 3 THEN round({_cue_sql(L.PAYMENT)} / 3.0, 6) END AS payment, CASE WHEN {_cue_sql(L.CREDENTIAL)} <= 2 THEN {_cue_sql(L.CREDENTIAL)} / 2.0 END AS credential,
    CAST({_cue_sql(L.GENERIC_SALUTATION)} > 0 AS INTEGER) AS salutation
    FROM (SELECT part_no, lower(concat(chr(10), body)) AS t FROM parts WHERE body IS NOT NULL)""")
def f30_nlp_features(spark: SparkSession, d: str) -> DataFrame:
    """Language features with the quarantine of out-of-range counts."""
    n = features.nlp_features(F.lit(""), F.col("body"), F.lit(""), F.lit(""))
    q = scoring.quarantine
    return table(spark, d, "parts").filter("body is not null").select(
        "part_no", F.round(n["urgency"], 6).alias("urgency"), F.round(n["payment_channel_change"], 6).alias("channel_change"), F.round(q(n["payment_request"]), 6).alias("payment"),
        q(n["credential_request"]).alias("credential"), n["generic_salutation"].cast("int").alias("salutation"),
    )


# --- correlation -----------------------------------------------------------------------------


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def a01_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return correlate.document_frequency(table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens("text").alias("tokens")))


_IDF = f"""WITH toks AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
    idf AS (SELECT term, ln((n + 1) / (count(DISTINCT id) + 1)) + 1 AS idf FROM toks, n GROUP BY term, n),
    raw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM toks JOIN idf USING (term) GROUP BY id, term),
    tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


@query(_IDF + " SELECT term, round(idf, 6) AS idf FROM idf")
def a02_idf(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens("text").alias("tokens"))
    return correlate.idf(t).select("term", F.round("idf", 6).alias("idf"))


@query(_IDF + " SELECT id, term, round(w, 6) AS w FROM tfidf")
def a03_tfidf(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens("text").alias("tokens"))
    return correlate.tfidf(t).select("id", "term", F.round("w", 6).alias("w"))


_REPLIES = "(SELECT doc_id AS b, parent_id AS a FROM documents WHERE parent_id IN (SELECT doc_id FROM documents))"


@query(_IDF + f" SELECT a, b, round(coalesce((SELECT sum(x.w * y.w) FROM tfidf x JOIN tfidf y USING (term) WHERE x.id = a AND y.id = b), 0), 6) AS cosine FROM {_REPLIES}")
def a04_reply_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Text similarity of every reply to its parent: two joins on the post, no join on terms."""
    docs = table(spark, d, "documents")
    w = correlate.tfidf(docs.select(F.col("doc_id").alias("id"), text.tokens("text").alias("tokens")))
    vec = materialize(w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v")), "vectors")
    pairs = docs.filter("parent_id is not null").select(F.col("parent_id").alias("a"), F.col("doc_id").alias("b")).join(docs.select(F.col("doc_id").alias("a")), "a", "left_semi")
    j = pairs.join(vec.select(F.col("id").alias("a"), F.col("v").alias("va")), "a", "left").join(vec.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b", "left")
    return j.select("a", "b", F.round(correlate.cosine("va", "vb"), 6).alias("cosine"))


@query(f"""WITH r AS {_REPLIES}, t AS (SELECT doc_id AS id, unnest({_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2),
    x AS (SELECT a, b, term, n AS ca, 0 AS cb FROM r JOIN c ON c.id = a UNION ALL SELECT a, b, term, 0, n FROM r JOIN c ON c.id = b), y AS (SELECT a, b, term, sum(ca) AS ca, sum(cb) AS cb FROM x GROUP BY 1, 2, 3),
    w AS (SELECT a, b, CASE WHEN ca > 0 THEN (1 + ln(ca)) * i ELSE 0 END AS wa, CASE WHEN cb > 0 THEN (1 + ln(cb)) * i ELSE 0 END AS wb FROM (SELECT *, CASE WHEN ca > 0 AND cb > 0 THEN 1 ELSE 1 + ln(1.5) END AS i FROM y)),
    g AS (SELECT a, b, sum(wa * wb) AS dot, sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)) AS norm FROM w GROUP BY 1, 2) SELECT a, b, round(coalesce(CASE WHEN norm > 0 THEN least(1, dot / norm) ELSE 0 END, 0), 6) AS cosine FROM r LEFT JOIN g USING (a, b)""")
def c06_single_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every reply and its parent, scored as a corpus of two."""
    docs = table(spark, d, "documents").select("doc_id", "parent_id", text.tokens("text").alias("tokens"))
    child = docs.filter("parent_id is not null").select(F.col("parent_id").alias("a"), F.col("doc_id").alias("b"), F.col("tokens").alias("tokens_b"))
    pairs = child.join(docs.select(F.col("doc_id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    return correlate.single_pairs(pairs).select("a", "b", F.round("cosine", 6).alias("cosine"))


_LSET = "list_distinct(list_filter(list_transform(coalesce({}, []), lambda v: trim({})), lambda v: v IS NOT NULL AND v <> ''))"
_DOC = f"""SELECT case_no AS id, {_LSET.format('domains', 'lower(v)')} AS dom, list_distinct({_LSET.format('addresses', 'lower(v)')} || {_LSET.format('hopaddresses', 'v')}) AS adr,
    {_LSET.format('attachmenthashes', 'v')} AS hsh, coalesce(subject, '') AS s, risk, confidence, CASE WHEN observedat >= 0 THEN observedat END AS ms FROM cases"""
_J = "CASE WHEN len(x.{0}) * len(y.{0}) > 0 THEN len(list_intersect(x.{0}, y.{0})) / len(list_distinct(x.{0} || y.{0})) ELSE 0 END"
_PAIRS = f"""WITH docs AS ({_DOC}), toks AS (SELECT id, unnest({_TOKENS.format("s || ' '")}) AS term FROM docs), n AS (SELECT count(*) AS n FROM docs),
    idf AS (SELECT term, ln((n + 1) / (count(DISTINCT id) + 1)) + 1 AS idf FROM toks, n GROUP BY term, n),
    raw AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM toks JOIN idf USING (term) GROUP BY id, term),
    tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
    keys AS (SELECT id, dm, unnest(adr) AS ad FROM (SELECT id, unnest(dom) AS dm, adr FROM docs)), near AS (SELECT DISTINCT k.id AS a, l.id AS b FROM keys k JOIN keys l ON k.dm = l.dm AND k.ad = l.ad AND k.id < l.id),
    cand AS (SELECT a, b, {_J.format('dom')} AS jd, {_J.format('adr')} AS ja, {_J.format('hsh')} AS jh FROM near JOIN docs x ON x.id = a JOIN docs y ON y.id = b),
    cosines AS (SELECT a, b, sum(p.w * q.w) AS c FROM cand JOIN tfidf p ON p.id = a JOIN tfidf q ON q.id = b AND q.term = p.term GROUP BY a, b),
    scored AS (SELECT a, b, jd, ja, jh, least(1, coalesce(c, 0)) AS c, least(1, 0.30 * jd + 0.20 * ja + 0.20 * least(1, coalesce(c, 0)) + 0.05 * jh) AS combined FROM cand LEFT JOIN cosines USING (a, b)),
    links AS (SELECT a, b FROM scored WHERE combined >= 0.62)"""


def _case_pairs(spark: SparkSession, d: str, tau: float | None = None) -> tuple[DataFrame, DataFrame]:
    docs = correlate.with_vectors(correlate.case_documents(table(spark, d, "cases")))
    return docs, materialize(correlate.pair_scores(docs, with_headers=False, tau=tau), "pairs")


@query(_PAIRS + " SELECT a, b, round(jd, 6) AS domains, round(ja, 6) AS addresses, round(jh, 6) AS hashes, round(c, 6) AS cosine, round(combined, 6) AS combined FROM scored")
def c05_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """J01, J02, C02, C03, C04, U01 and L04 as well: every pair of cases that can be linked, all of them scored."""
    _, p = _case_pairs(spark, d)
    r = lambda c: F.round(c, 6)
    return p.select("a", "b", r("j_domains").alias("domains"), r("j_addresses").alias("addresses"), r("j_attachment_hashes").alias("hashes"), r("text_cosine").alias("cosine"), r("combined").alias("combined"))


_COMP = _PAIRS + """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS id, min(b) AS m FROM both_ways GROUP BY a)"""


def _link_sql(tail: str) -> str:
    return _PAIRS.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, seen) AS (SELECT DISTINCT a, a FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
    comps AS (SELECT id, min(seen) AS root FROM reach GROUP BY id)""" + tail


@query(_link_sql(" SELECT id, root FROM comps"))
def c08_clusters(spark: SparkSession, d: str) -> DataFrame:
    _, p = _case_pairs(spark, d, L.TAU_CLUSTER)
    return correlate.clusters(p.filter(F.col("combined") >= L.TAU_CLUSTER).select("a", "b"))


@query(_link_sql(""", per AS (SELECT root, count(*) AS size, CAST(100 * (1 - product(1 - greatest(0, least(100, risk)) / 100)) AS DOUBLE) AS risk, avg(confidence) AS confidence, min(ms) AS first_ms, max(ms) AS last_ms FROM comps JOIN docs USING (id) GROUP BY root),
    ins AS (SELECT x.root, combined, CASE WHEN greatest(jd, ja, 0.5 * c, jh) <= 0 THEN 'none' WHEN greatest(jd, ja) >= greatest(0.5 * c, jh) THEN 'infrastructure' WHEN 0.5 * c >= jh THEN 'content' ELSE 'attachments' END AS dom FROM scored JOIN comps x ON x.id = a JOIN comps y ON y.id = b AND x.root = y.root)
    , usual AS (SELECT root, arg_min(dom, (-n, dom)) AS dominant FROM (SELECT root, dom, count(*) AS n FROM ins WHERE combined >= 0.62 GROUP BY 1, 2) GROUP BY 1)
    SELECT root, size, round(risk, 6) AS risk, round(confidence, 6) AS confidence, first_ms, last_ms, round(cohesion, 6) AS cohesion, round(weakest, 6) AS weakest, links, dominant
    FROM per LEFT JOIN (SELECT root, avg(combined) FILTER (WHERE combined >= 0.62) AS cohesion, min(combined) AS weakest, count(*) FILTER (WHERE combined >= 0.62) AS links FROM ins GROUP BY root) USING (root) LEFT JOIN usual USING (root)"""))
def c09_campaigns(spark: SparkSession, d: str) -> DataFrame:
    """A05, A06, A07, A08, C10 and J08 as well."""
    docs, p = _case_pairs(spark, d, L.TAU_CLUSTER)
    m = materialize(correlate.clusters(p.filter(F.col("combined") >= L.TAU_CLUSTER).select("a", "b")), "members")
    c = correlate.campaigns(docs, m, p.unionByName(correlate.pair_scores(docs, correlate.missed_pairs(m, p))))
    r = lambda x: F.round(x, 6).alias(x)
    return c.select("root", "size", r("risk"), r("confidence"), "first_ms", "last_ms", r("cohesion"), r("weakest"), "links", "dominant")


@query(_link_sql(" SELECT id FROM docs WHERE id NOT IN (SELECT id FROM comps)"))
def u02_unclustered(spark: SparkSession, d: str) -> DataFrame:
    docs, p = _case_pairs(spark, d, L.TAU_CLUSTER)
    return correlate.unclustered(docs, correlate.clusters(p.filter(F.col("combined") >= L.TAU_CLUSTER).select("a", "b")))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, parent_id AS b FROM documents WHERE parent_id IS NOT NULL UNION SELECT parent_id, doc_id FROM documents WHERE parent_id IS NOT NULL),
    reach(id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.seen) SELECT id, min(seen) AS root FROM reach GROUP BY id""")
def c08_thread_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the reply graph."""
    e = table(spark, d, "documents").filter("parent_id is not null").select(F.col("doc_id").alias("a"), F.col("parent_id").alias("b"))
    return graph.components(e)


@query(_link_sql(" SELECT root, count(*) AS size, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM comps GROUP BY root ORDER BY size DESC, members"))
def l03_cluster_order(spark: SparkSession, d: str) -> DataFrame:
    _, p = _case_pairs(spark, d, L.TAU_CLUSTER)
    return correlate.ordered_clusters(correlate.clusters(p.filter(F.col("combined") >= L.TAU_CLUSTER).select("a", "b")))


@query("SELECT o_custkey, round(100 * (1 - product(1 - greatest(0, least(100, o_totalprice / 5000)) / 100)), 6) AS risk, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1")
def a05_campaign_risk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.round(correlate.campaign_risk(F.col("o_totalprice") / 5000), 6).alias("risk"), F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price")
    )


@query("SELECT o_custkey, arg_min(o_orderpriority, (-c, o_orderpriority)) AS usual FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY 1")
def a08_mode(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("o_custkey").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("o_orderpriority").alias("v")))["v"].alias("usual"))


# --- attribution and enrichment --------------------------------------------------------------


@query(f"""SELECT msg_no, count(*) AS n_hops, count(DISTINCT CASE WHEN scope = 'PUBLIC' THEN ip END) AS n_public, count(*) FILTER (WHERE scope = 'PRIVATE') AS n_private,
    round(avg(CASE WHEN scope = 'PRIVATE' OR (ip IS NOT NULL AND scope NOT IN ('PUBLIC', 'PRIVATE')) THEN 0 ELSE 1 END), 6) AS t FROM (SELECT *, {SCOPE_SQL} AS scope FROM hops) GROUP BY msg_no""")
def a12_transparency(spark: SparkSession, d: str) -> DataFrame:
    """A16 as well."""
    h = table(spark, d, "hops").withColumn("scope", net.ip_scope("ip"))
    hidden = (F.col("scope") == "PRIVATE") | (F.col("ip").isNotNull() & ~F.col("scope").isin("PUBLIC", "PRIVATE"))
    return h.groupBy("msg_no").agg(
        F.count(F.lit(1)).alias("n_hops"), F.count_distinct(F.when(F.col("scope") == "PUBLIC", F.col("ip"))).alias("n_public"), F.count(F.when(F.col("scope") == "PRIVATE", 1)).alias("n_private"),
        F.round(F.avg(F.when(hidden, 0.0).otherwise(1.0)), 6).alias("t"),
    )


@query(f"""SELECT msg_no, arg_max(ip, (hopindex, hop_no)) AS primary_ip, max(hopindex) AS primary_index FROM (SELECT *, {SCOPE_SQL} AS scope FROM hops) WHERE scope = 'PUBLIC' GROUP BY msg_no""")
def w01_primary_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """First public address of the chain by header depth."""
    h = table(spark, d, "hops").filter(net.ip_scope("ip") == "PUBLIC")
    return h.groupBy("msg_no").agg(F.max(F.struct("hopindex", "hop_no", "ip")).alias("m")).select("msg_no", F.col("m.ip").alias("primary_ip"), F.col("m.hopindex").alias("primary_index"))


ASNS = {"bench wide": "AS64500", "bench low": "AS64501", "docs three": "AS64502", "docs two": "AS64503", "bench seven": "AS64504", "single": "AS64505"}
RELAYS = [("smtp4.wendelwick.test", 2900, True), ("edge7.talsen.example", 41, True), ("relay3.pelhalmark.test", 365, None), ("relay5.marwick.example", None, False), ("edge4.peljorlin.invalid", 3, False)]


def attributed(spark: SparkSession, h: DataFrame) -> DataFrame:
    """Attribution of hops with hints: fixed stand-ins, like networks(), for what an analyst supplies."""
    known = enrich.longest_prefix(h.select("ip"), networks(spark)).select("ip", "country", "organization")
    known = known.join(F.broadcast(spark.createDataFrame(list(ASNS.items()), "organization string, asn string")), "organization", "left")
    relays = attribution.domain_hints(spark.createDataFrame([(i, *r) for i, r in enumerate(RELAYS)], "row_no int, domain string, age_days int, mx boolean"))
    return attribution.attribute(h, known, relays, anonymiser_asns=("AS64504",), anonymiser_orgs=("bench seven",), proxy_hosts=("edge8.",))


@query("SELECT user_id, count(*) FILTER (WHERE ts < prev) AS back, count(*) FILTER (WHERE gap > 3600) AS long_gaps FROM (SELECT user_id, ts, lag(ts) OVER w AS prev, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def w02_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    """A17 as well: order of events against their ids."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "ts", F.lag("ts").over(w).alias("prev"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("prev").cast("timestamp")) / 1e6
    return e.groupBy("user_id").agg(F.count(F.when(F.col("ts") < F.col("prev"), 1)).alias("back"), F.count(F.when(gap > 3600, 1)).alias("long_gaps"))


NETS = [("198.18.0.0/15", "XA", "bench wide"), ("198.18.0.0/16", "XB", "bench low"), ("203.0.113.0/24", "XC", "docs three"), ("198.51.100.0/24", "XD", "docs two"), ("10.0.0.0/8", "XE", "inside"), ("198.18.7.0/24", "XF", "bench seven"), ("bad/99", "XG", "broken"), ("192.0.2.11", "XH", "single")]


def networks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(NETS)], "row_no int, net string, country string, organization string")


_NETSQL = ", ".join(
    f"({i}, {sum(int(x) << (24 - 8 * k) for k, x in enumerate(n.split('/')[0].split('.')))}, {n.split('/')[1] if '/' in n else 32}, '{c}')" for i, (n, c, _) in enumerate(NETS) if n[0].isdigit()
)


@query(f"""SELECT ip, country, prefix FROM (SELECT ip, country, prefix, row_number() OVER (PARTITION BY ip ORDER BY prefix DESC, r) AS k FROM (SELECT DISTINCT ip, {_NUM} AS n FROM hops) a
    JOIN (VALUES {_NETSQL}) v(r, lo, prefix, country) ON a.n >= lo AND a.n < lo + CAST(pow(2, 32 - prefix) AS BIGINT)) WHERE k = 1""")
def j03_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """E02 and S06's network rows as well."""
    return enrich.longest_prefix(table(spark, d, "hops").select("ip"), networks(spark)).select("ip", "country", "prefix")


_KNOWN = f"""(SELECT ip, country, organization FROM (SELECT ip, country, organization, row_number() OVER (PARTITION BY ip ORDER BY prefix DESC, r) AS k FROM (SELECT DISTINCT ip, {_NUM} AS n FROM hops) a
    JOIN (VALUES {', '.join(f"({i}, {sum(int(x) << (24 - 8 * k) for k, x in enumerate(n.split('/')[0].split('.')))}, {n.split('/')[1] if '/' in n else 32}, '{c}', '{o}')" for i, (n, c, o) in enumerate(NETS) if n[0].isdigit())}) v(r, lo, prefix, country, organization)
    ON a.n >= lo AND a.n < lo + CAST(pow(2, 32 - prefix) AS BIGINT)) WHERE k = 1)"""
_FIXED = [("203.0.113.9", "ZZ", "fixed.example"), ("198.18.7.7", None, "seven.example"), ("8.8.8.8", " - ", "n/a")]


@query(f"""SELECT ip, country, CASE WHEN country IS NULL THEN 'UNAVAILABLE' ELSE 'KNOWN' END AS country_status, source AS country_source, hostname, organization, CASE WHEN organization IS NULL THEN 'UNAVAILABLE' ELSE 'KNOWN' END AS organization_status,
    CASE WHEN country IS NULL AND hostname IS NULL AND organization IS NULL THEN 'a provider was not available' END AS reason FROM (SELECT i.ip, coalesce(f.c, k.country) AS country, CASE WHEN f.c IS NOT NULL THEN 'fixed' WHEN k.country IS NOT NULL THEN 'dataset' END AS source, f.h AS hostname, k.organization AS organization
    FROM (SELECT DISTINCT ip FROM hops WHERE ip IS NOT NULL) i LEFT JOIN (VALUES ('203.0.113.9', 'ZZ', 'fixed.example'), ('198.18.7.7', NULL, 'seven.example')) f(ip, c, h) ON f.ip = i.ip LEFT JOIN {_KNOWN} k ON k.ip = i.ip)""")
def e01_providers(spark: SparkSession, d: str) -> DataFrame:
    """J04, E05, E06 and E08 as well: three providers in order, one of them down."""
    ips = table(spark, d, "hops").select("ip").filter("ip is not null")
    known = enrich.longest_prefix(ips, networks(spark)).select("ip", "country", "organization")
    fixed = spark.createDataFrame(_FIXED, "ip string, country string, hostname string")
    p = enrich.provider_join(ips, [("fixed", fixed, True), ("dataset", known, True), ("remote", fixed, False)])
    return p.select("ip", "country", "country_status", "country_source", "hostname", "organization", "organization_status", "reason")


@query("""SELECT s_suppkey, CASE k WHEN 0 THEN 'DE' WHEN 1 THEN 'SE' WHEN 3 THEN 'AT' END AS rdap_country, CASE k WHEN 0 THEN 'net' WHEN 1 THEN s_name WHEN 3 THEN s_name END AS rdap_hostname, CASE k WHEN 0 THEN s_name WHEN 1 THEN 'Flat ' || s_name END AS rdap_org,
    CASE WHEN k = 0 THEN 'H-1' END AS rdap_isp, CASE WHEN k = 1 THEN 'AS' || s_suppkey END AS rdap_asn, 'DE' AS whois_country, s_name AS whois_org, 'AS64500' AS asn FROM (SELECT *, s_suppkey % 4 AS k FROM supplier)""")
def e03_registry_texts(spark: SparkSession, d: str) -> DataFrame:
    """P28, P29 and E04 as well: registry answers built from suppliers, in all forms, and texts that aren't any."""
    s = table(spark, d, "supplier")
    name = F.col("s_name")
    forms = [
        F.concat(F.lit('{"networks":[null,{"country":"de","name":"net","entities":[{"roles":["Registrant"],"vcardArray":["vcard",[["fn",{},"text","'), name, F.lit('"]]]},{"roles":["administrative"],"handle":"H-1"}]}]}')),
        F.concat(F.lit('{"handle":"AS'), F.col("s_suppkey").cast("string"), F.lit('","name":"'), name, F.lit('","entities":[{"roles":["registrant"],"vcardArray":[["fn","adr"],{"fn":"Flat '), name, F.lit('","adr":["a","b","c","se"]}]}]}')),
        F.concat(F.lit('{"country":"DE", '), name), F.concat(F.lit('{"country":" at ","remarks":[{"description":["","'), name, F.lit('"]}]}')),
    ]
    rdap = F.when(F.col("s_suppkey") % 4 == 0, forms[0]).when(F.col("s_suppkey") % 4 == 1, forms[1]).when(F.col("s_suppkey") % 4 == 2, forms[2]).otherwise(forms[3])
    whois = F.concat(F.lit("% comment\ncountry: de\norg-name: "), name, F.lit("\norigin: as64500\ncountry: fr"))
    x = s.select("s_suppkey", enrich.parse_rdap(rdap).alias("r"), enrich.parse_whois(whois).alias("w"))
    return x.select("s_suppkey", *[F.col(f"r.{a}").alias(f"rdap_{b}") for a, b in (("country", "country"), ("hostname", "hostname"), ("organization", "org"), ("isp", "isp"), ("asn", "asn"))], F.col("w.country").alias("whois_country"), F.col("w.organization").alias("whois_org"), F.col("w.asn").alias("asn"))


@query("""SELECT hop_no, ip IS NOT NULL AND (ip LIKE '203.0.113.%' OR ip LIKE '198.51.100.%' OR (ip LIKE '192.0.2.%' AND CAST(string_split(ip, '.')[4] AS INTEGER) >= 128)) AS in_range FROM hops""")
def r05_mail_range(spark: SparkSession, d: str) -> DataFrame:
    """Whether a hop's address lies in the organisation's mail ranges."""
    ranges = ["203.0.113.0/24", "198.51.100.0/24", "192.0.2.128/25"]
    return table(spark, d, "hops").select("hop_no", orgprofile.in_mail_range(F.col("ip"), ranges).alias("in_range"))


@query("SELECT part_no, contains(lower(body), 'abuse@kit.test') OR contains(lower(body), 'weekly backup') AS quoted FROM parts")
def r06_abuse_contact(spark: SparkSession, d: str) -> DataFrame:
    """Whether a body quotes the abuse contact or its local part; NULL without a body."""
    b = F.col("body")
    return table(spark, d, "parts").select("part_no", (orgprofile.abuse_contact_quoted(b, "abuse@kit.test") | orgprofile.abuse_contact_quoted(b, "Weekly Backup@kit.test")).alias("quoted"))


@query("SELECT case_no, coalesce(list_bool_or(list_transform(domains, lambda v: lower(v) = 'tarnwick.example' OR lower(v) LIKE '%.tarnwick.example' OR lower(v) LIKE '%.branquarstad.test' OR lower(v) = 'branquarstad.test')), false) AS own FROM cases WHERE domains IS NOT NULL")
def r04_own_domain(spark: SparkSession, d: str) -> DataFrame:
    own = ["tarnwick.example", "branquarstad.test"]
    c = table(spark, d, "cases").filter("domains is not null")
    return c.select("case_no", F.coalesce(F.exists("domains", lambda v: F.coalesce(orgprofile.domain_member(v, own), F.lit(False))), F.lit(False)).alias("own"))


# --- cases, audit, export --------------------------------------------------------------------


@query("SELECT id, case_no FROM cases WHERE status = 'open' AND (contains(lower(coalesce(subject, '')), 'invoice') OR contains(lower(coalesce(title, '')), 'invoice') OR contains(lower(coalesce(id, '')), 'invoice') OR contains(lower(coalesce(messageid, '')), 'invoice') OR list_bool_or(list_transform(coalesce(domains, []) || coalesce(urls, []) || coalesce(attachmenthashes, []), lambda v: contains(lower(v), 'invoice')))) ORDER BY CASE WHEN observedat >= 0 THEN observedat END DESC NULLS LAST, id, case_no LIMIT 20")
def k04_search_page(spark: SparkSession, d: str) -> DataFrame:
    """R01, R02, L01 and L02 as well: the first page of open cases about invoices."""
    return cases.search(table(spark, d, "cases"), "invoice", "open", page=1).select("id", "case_no")


@query("SELECT count(*) FILTER (WHERE status = 'open') AS total, CAST(greatest(0, least(20, count(*) FILTER (WHERE status = 'open') - 20)) AS BIGINT) AS returned, count(*) AS scanned, false AS truncated FROM cases")
def a21_page_totals(spark: SparkSession, d: str) -> DataFrame:
    return cases.page_totals(table(spark, d, "cases"), "", "open", page=2)


@query("SELECT id, case_no, status, risk, band FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingestedat DESC NULLS LAST, case_no DESC) AS n FROM cases WHERE id IS NOT NULL) WHERE n = 1")
def w05_latest_case(spark: SparkSession, d: str) -> DataFrame:
    """J09 as well."""
    return cases.latest(table(spark, d, "cases"))


@query("SELECT case_no, risk IS NOT NULL OR domains IS NOT NULL OR urls IS NOT NULL OR attachmenthashes IS NOT NULL AS accepted FROM cases")
def s04_append_guard(spark: SparkSession, d: str) -> DataFrame:
    return cases.storable(table(spark, d, "cases")).select("case_no", "accepted")


@query("SELECT case_no, CASE WHEN length(b) BETWEEN 1 AND 256 THEN b ELSE 'sha256:' || evidencehash END AS document FROM (SELECT case_no, evidencehash, regexp_replace(messageid, '^[\\s<]+|[>\\s]+$', '', 'g') AS b FROM cases)")
def k03_document_id(spark: SparkSession, d: str) -> DataFrame:
    """K01 as well."""
    return table(spark, d, "cases").select("case_no", cases.document_id(F.col("messageid"), F.col("evidencehash")).alias("document"))


_ASKED = "CASE case_no % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' END"


@query(f"SELECT case_no, coalesce(CASE WHEN risk >= 40 THEN true ELSE lower({_ASKED}) IN ('analyst', 'true') END, false) AS opened FROM cases")
def k02_opening(spark: SparkSession, d: str) -> DataFrame:
    """Every case: opened by the model, or on what the request says."""
    return table(spark, d, "cases").select("case_no", F.coalesce(cases.opening(F.col("risk") >= 40, F.expr(_ASKED)), F.lit(False)).alias("opened"))


@query("SELECT case_no, sha256(coalesce(evidencehash, '') || coalesce(messageid, '')) AS seal FROM cases")
def x17_sha256(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.coalesce("evidencehash", F.lit("")), F.coalesce("messageid", F.lit("")))
    return table(spark, d, "cases").select("case_no", F.sha2(c, 256).alias("seal"))


def order_chains(spark: SparkSession, d: str) -> DataFrame:
    """(key, pos, line): one audit chain per customer over all orders; some orders are altered after they were sealed, in five ways."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))

    def step(acc, k):
        tail = F.concat(F.lit('"index":'), F.size(acc["lines"]).cast("string"), F.lit(',"payload":{"subject":"'), k.cast("string"), F.lit('"},"prev_hash":"'), acc["prev"], F.lit('","ts":"2024-01-01T00:00:00Z"}'))
        head = F.lit('{"event":"order",')

        def seal(t):
            h = F.sha2(F.concat(acc["prev"], head, t), 256)
            return let(h, lambda x: F.struct(x.alias("prev"), F.concat(acc["lines"], F.array(F.concat(head, F.lit('"hash":"'), x, F.lit('",'), t))).alias("lines")))

        return let(tail, seal)

    start = F.struct(F.lit(L.GENESIS).alias("prev"), F.array().cast("array<string>").alias("lines"))
    lines = o.select("key", "orders", F.aggregate("orders", start, step, lambda acc: acc["lines"]).alias("lines"))
    x = lines.select("key", F.posexplode(F.arrays_zip("orders", "lines")).alias("pos", "x"))
    k, line = F.col("x.orders") % 97, F.col("x.lines")
    altered = (
        F.when(k == 0, F.replace(line, F.lit('"event":"order"'), F.lit('"event":"other"')))
        .when(k == 1, F.lit("not a record"))
        .when(k == 2, F.replace(line, F.lit('"event":"order",'), F.lit("")))
        .when(k == 3, F.regexp_replace(line, '"index":([0-9]+)', '"index":$1.5'))
        .when(k == 4, F.regexp_replace(line, '"prev_hash":"[0-9a-f]{8}', '"prev_hash":"00000000'))
        .otherwise(line)
    )
    return x.select("key", F.col("pos").cast("bigint").alias("pos"), altered.alias("line"))


_CHAIN = "SELECT o_custkey AS key, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders"


_REASONS = "CASE k % 97 WHEN 0 THEN 'hash mismatch' WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'missing field' WHEN 3 THEN 'index gap' WHEN 4 THEN 'prev_hash mismatch' END"


@query(f"""SELECT key, bool_and(k % 97 > 4) AS ok, count(*) AS records, min(pos) FILTER (WHERE k % 97 <= 4) AS divergence, arg_min({_REASONS}, pos) FILTER (WHERE k % 97 <= 4) AS reason,
    CASE WHEN bool_or(k % 97 <= 4) THEN 'TAMPERED' ELSE 'UNSIGNED' END AS assurance FROM ({_CHAIN}) GROUP BY key""")
def h02_verify_chains(spark: SparkSession, d: str) -> DataFrame:
    """W04 and H01 as well: the chain of every customer verified; altered records are found where they are, with their reason."""
    return audit.status(order_chains(spark, d), None, None, keys=["key"]).select("key", "ok", "records", "divergence", "reason", "assurance")


SEED = bytes(range(32))


@query(f"""SELECT key, records, last_signed, head_signed, at_head AND NOT head_signed AS forged, CASE WHEN NOT ok OR (at_head AND NOT head_signed) THEN 'TAMPERED' WHEN last_signed IS NOT NULL THEN 'SIGNED' WHEN records >= 5 THEN 'TAMPERED' ELSE 'UNSIGNED' END AS assurance
    FROM (SELECT *, coalesce(ok AND at_head AND last_signed = records - 1, false) AS head_signed FROM (SELECT key, count(*) AS records, bool_and(k % 97 > 4) AS ok, max(pos) FILTER (WHERE (pos + 1) % 5 = 0 AND key % 11 > 1 AND k % 97 <> 1) AS last_signed, count(*) % 5 = 0 AND key % 11 <> 1 AS at_head FROM ({_CHAIN}) GROUP BY key))""")
def h03_signatures(spark: SparkSession, d: str) -> DataFrame:
    """H04, H05 and J07 as well: every fifth record of each chain signed; the signatures of some chains forged, of some lost."""
    from postern.functions import ed25519

    lines = order_chains(spark, d)  # sealed twice: written, it is many times its input
    # Signed before the lines were altered: a line that can't be read still has its signature.
    due = lines.withColumn("line", F.when(F.get_json_object("line", "$.hash").isNull(), F.lit('{"hash":"0"}')).otherwise(F.col("line")))
    s = audit.sign_heads(due, SEED, 5, ["key"]).filter("key % 11 <> 1")
    s = materialize(s.withColumn("signature", F.when(F.col("key") % 11 == 0, F.concat(F.lit("AAAA"), F.substring("signature", 5, 1000))).otherwise(F.col("signature"))), "signatures")
    v = audit.status(lines, s, ed25519.public_key(SEED), 5, ["key"])
    return v.select("key", "records", "last_signed", "head_signed", "forged", "assurance")


# --- evaluation ------------------------------------------------------------------------------

_EV = "(SELECT l_orderkey * 10 + l_linenumber AS k, round(l_quantity / 50 * 0.7 + l_discount * 3, 4) AS s, CAST(l_quantity > 30 OR l_tax > 0.06 AS INTEGER) AS y, l_returnflag AS truth, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 25 THEN 'A' ELSE 'R' END ELSE 'N' END AS predicted FROM lineitem)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.round(q / 50 * 0.7 + F.col("l_discount") * 3, 4).alias("s"), ((q > 30) | (F.col("l_tax") > 0.06)).cast("int").alias("y"),
        F.col("l_returnflag").alias("truth"), F.when(F.col("l_linestatus") == "F", F.when(q > 25, "A").otherwise("R")).otherwise("N").alias("predicted"),
    )


@query(f"""SELECT c AS class, s.support, CASE WHEN said > 0 THEN round(tp / said, 6) ELSE 0 END AS precision, CASE WHEN support > 0 THEN round(tp / support, 6) ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN round(2 * (tp / said) * (tp / support) / (tp / said + tp / support), 6) ELSE 0 END AS f1
    FROM (SELECT truth AS c, count(*) AS support, count(*) FILTER (WHERE predicted = truth) AS tp FROM {_EV} GROUP BY 1) s JOIN (SELECT predicted AS c, count(*) AS said FROM {_EV} GROUP BY 1) p USING (c)""")
def d01_per_class(spark: SparkSession, d: str) -> DataFrame:
    r = lambda x: F.round(x, 6).alias(x)
    return evaluate.per_class(labelled(spark, d)).select("class", "support", r("precision"), r("recall"), r("f1"))


@query(f"""SELECT tp, fp, tn, fn, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fn), 6) AS tpr
    FROM (SELECT CAST(count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y = 0 AND s < 0.5) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 1 AND s < 0.5) AS DOUBLE) AS fn FROM {_EV})""")
def d02_binary(spark: SparkSession, d: str) -> DataFrame:
    r = lambda x: F.round(x, 6).alias(x)
    return evaluate.binary(labelled(spark, d), "s", "y", 0.5).select("tp", "fp", "tn", "fn", r("mcc"), r("fpr"), r("tpr"))


@query(f"""SELECT round(sum(n * (before + p * 0.5)) / (max(np) * max(nn)), 6) AS roc_auc FROM (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) - p AS before, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_EV} GROUP BY s))""")
def d03_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(labelled(spark, d), "s", "y").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y), 6) AS rate, round(abs(avg(s) - avg(y)), 6) AS gap FROM {_EV} GROUP BY 1")
def d04_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.calibration(labelled(spark, d), "s", "y")
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_score", "rate", "gap")])


@query(f"SELECT min(s) AS tau, round(arg_min(tp / np, s), 6) AS recall FROM (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_EV} GROUP BY s)) WHERE fp <= 0.05 * nn")
def d05_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_for_fpr(labelled(spark, d), "s", "y", 0.05).select("tau", F.round("recall", 6).alias("recall"))


@query("""SELECT o_orderkey, CASE WHEN n >= 8 THEN round(1 - exp(-greatest(0, (o_totalprice - mu) / nullif(sd, 0)) / 1.5), 6) END AS deviation FROM (SELECT o_orderkey, o_totalprice, count(*) OVER w AS n, avg(o_totalprice) OVER w AS mu, stddev_samp(o_totalprice) OVER w AS sd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def d09_sender_baseline(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sender_baseline(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", F.round("deviation", 6).alias("deviation"))


@query()
def d13_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap_mean(labelled(spark, d), "k", "y", 1000)


@query("""SELECT user_id, ts, event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) >= 2 AS alert FROM events""")
def w06_failure_window(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the last 15 minutes per account."""
    e = table(spark, d, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("u").rangeBetween(-900_000_000, 0)
    return e.select("user_id", "ts", "event_id", (F.count(F.when(F.col("event_type") == "error", 1)).over(w) >= 2).alias("alert"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j10_anti_membership(spark: SparkSession, d: str) -> DataFrame:
    """Exact membership as a semi or anti join against a list."""
    n = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_anti").select("c_custkey")


@query("SELECT case_no, len(list_distinct(list_filter(coalesce(addresses, []), lambda v: v LIKE '%@%'))) AS mailboxes, len(list_distinct(list_filter(coalesce(hopaddresses, []), lambda v: v IS NOT NULL))) AS hops FROM cases")
def u06_case_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct value sets of a case."""
    e = F.array().cast("array<string>")
    return table(spark, d, "cases").select(
        "case_no", F.size(F.array_distinct(F.filter(F.coalesce("addresses", e), lambda v: F.contains(v, F.lit("@"))))).cast("bigint").alias("mailboxes"),
        F.size(F.array_distinct(F.filter(F.coalesce("hopaddresses", e), lambda v: v.isNotNull()))).cast("bigint").alias("hops"),
    )
