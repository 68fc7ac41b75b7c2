"""Queries of evaluation and of what follows from scores: confidence, thresholds, labelling, threads, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import scoring
from postern.operators import evaluate, fitting
from postern.plans import analysis
from postern.plans.analysis import _EV, _SCORED, labelled
from postern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


_PER = f"""(SELECT s.support, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * (tp / said) * (tp / support) / (tp / said + tp / support) ELSE 0 END AS f1
    FROM (SELECT truth AS c, count(*) AS support, count(*) FILTER (WHERE predicted = truth) AS tp FROM {_EV} GROUP BY 1) s LEFT JOIN (SELECT predicted AS c, count(*) AS said FROM {_EV} GROUP BY 1) p USING (c))"""


@query(f"SELECT round((SELECT avg(CAST(truth = predicted AS INTEGER)) FROM {_EV}), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy FROM {_PER}")
def d01_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overall(labelled(spark, d)).select(*_r("accuracy", "macro_f1", "balanced_accuracy"))


_CURVE = f"(SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_EV} GROUP BY s))"


@query(f"SELECT round(coalesce(arg_min(tp / np, s), 0), 6) AS recall FROM {_CURVE} WHERE fp <= 0.001 * nn")
def d02_recall_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at_fpr(labelled(spark, d), "s", "y").select(*_r("recall"))


@query(f"""SELECT round(sum((fp - f0) * (tp + t0) / 2.0) / max(np * nn), 6) AS roc_auc, round(sum((tp - t0) * (tp / (tp + fp) + CASE WHEN t0 + f0 > 0 THEN t0 / (t0 + f0) ELSE tp / (tp + fp) END) / 2.0) / max(np), 6) AS pr_auc
    FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS t0, coalesce(lag(fp) OVER (ORDER BY s DESC), 0) AS f0 FROM {_CURVE})""")
def d03_curve_areas(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(labelled(spark, d), "s", "y").select(*_r("roc_auc", "pr_auc"))


@query(f"""SELECT round((SELECT avg((s - y) * (s - y)) FROM {_EV}), 6) AS brier, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM (SELECT least(floor(s * 10), 9) AS bin, count(*) AS n, abs(avg(s) - avg(y)) AS gap FROM {_EV} GROUP BY 1)""")
def d04_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration_error(labelled(spark, d), "s", "y").select(*_r("brier", "ece", "mce"))


_ABS = "[" + ", ".join("[" + ", ".join(repr(abs(v)) for v in row) + "]" for row in scoring.weights()) + "]"
_COVER = f"(list_sum(list_transform(range(1, 61), lambda i: CASE WHEN x[i] IS NOT NULL THEN ({_ABS}[k])[i] ELSE 0 END)) / list_sum({_ABS}[k]))"


@query(f"SELECT o_orderkey, round({_COVER.replace('[k]', '[4]')}, 6) AS coverage FROM (SELECT o_orderkey, {analysis._X} AS x FROM orders)")
def a10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return analysis.order_vectors(spark, d).select("o_orderkey", F.round(scoring.coverage("x", 3), 6).alias("coverage"))


@query(f"""SELECT o_orderkey, round(c, 6) AS combined, CASE WHEN c < 0.5 THEN 'UNDETERMINED' WHEN c < 0.7 THEN 'LOW_CONFIDENCE_REVIEW_ADVISED' ELSE 'DETERMINED' END AS verdict,
    CASE WHEN rf >= 80 THEN 'CRITICAL' WHEN rf >= 60 THEN 'HIGH' WHEN rf >= 40 THEN 'MEDIUM' WHEN rf >= 20 THEN 'LOW' ELSE 'NONE' END AS severity FROM (SELECT *, conf * {_COVER} AS c FROM (SELECT *, list_position(p, list_max(p)) AS k FROM ({_SCORED})))""")
def d06_combined_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = analysis.scored(spark, d).withColumn("c", evaluate.combined_confidence(F.col("confidence"), evaluate.class_coverage("x", "top")))
    return s.select("o_orderkey", F.round("c", 6).alias("combined"), scoring.abstention("c").alias("verdict"), evaluate.severity(F.col("risk_final")).alias("severity"))


@query(f"SELECT count(*) FILTER (WHERE s >= 0.9) AS confident, round(avg(y) FILTER (WHERE s >= 0.9), 6) AS accuracy_confident, round(avg(y), 6) AS accuracy FROM {_EV}")
def d06_confident_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confident_accuracy(labelled(spark, d), "s", F.col("y") == 1).select("confident", *_r("accuracy_confident", "accuracy"))


@query()
def d07_fitted_model(spark: SparkSession, d: str) -> DataFrame:
    """Weights fitted on the orders' vectors, labelled by the hand-set model: one row per class and feature."""
    v = analysis.scored(spark, d).select(F.col("o_orderkey").alias("id"), F.col("top").alias("label"), "x")
    m, figures = fitting.fit(v)
    rows = [(L.CLASSES[k], L.FEATURES[i], w, figures["temperature"], figures["test_accuracy"]) for k, row in enumerate(m.beta) for i, w in enumerate(row)]
    return spark.createDataFrame(rows, "class string, feature string, weight double, temperature double, test_accuracy double")


_HAV = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))))"


@query(f"""SELECT event_id, round(km, 3) AS km, sec AS seconds, sec > 0 AND sec < 7200 AND CASE WHEN sec > 0 THEN km / sec * 3600 > 900 END AS impossible FROM (SELECT event_id, {_HAV} AS km, epoch_us(ts) // 1000000 - epoch_us(t) // 1000000 AS sec
    FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(ts) OVER w AS t FROM (SELECT event_id, user_id, ts, CAST(event_id % 180 - 90 AS DOUBLE) AS lat, CAST(event_id * 7 % 360 - 180 AS DOUBLE) AS lon FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)))""")
def d08_velocity(spark: SparkSession, d: str) -> DataFrame:
    """W08 as well: speed between consecutive events of a user."""
    e = table(spark, d, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "lat": (F.col("event_id") % 180 - 90).cast("double"), "lon": (F.col("event_id") * 7 % 360 - 180).cast("double")})
    v = evaluate.hop_velocity(e, "user_id", "ts", "lat", "lon")
    return v.select("event_id", F.round("km", 3).alias("km"), "seconds", "impossible")


_REP = r"^(?:\s*(?:re|fwd?|aw|tr|wg)\s*:\s*)+"
_HIJACK = f"""(SELECT case_no AS id, coalesce(createdat, -1) AS seq, hopaddresses[1] AS origin, trim(regexp_replace(lower(coalesce(subject, '')), '{_REP}', ''), ' ') AS plain, coalesce(regexp_matches(lower(subject), '{_REP}'), false) AS marked,
    array_to_string(list_sort(list_distinct(list_filter(coalesce(domains, []), lambda v: v IS NOT NULL))), ',') AS parties FROM cases)"""


@query(f"""SELECT id, thread, continued, new_origin, asks, continued AND new_origin AND asks AS hijack FROM (SELECT id, plain || '|' || parties AS thread, plain <> '' AND marked AND row_number() OVER (PARTITION BY plain, parties ORDER BY seq, id) > 1 AS continued,
    origin IS NOT NULL AND row_number() OVER (PARTITION BY plain, parties, origin ORDER BY seq, id) = 1 AS new_origin, {' OR '.join(f"contains(plain, '{c}')" for c in [*L.PAYMENT, *L.CHANNEL_CHANGE, *[p for p, _ in L.URGENCY]])} AS asks FROM {_HIJACK})""")
def d10_thread_hijack(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases")
    m = c.select(F.col("case_no").alias("id"), F.coalesce("createdat", F.lit(-1)).alias("seq"), "subject", F.filter(F.coalesce("domains", F.array().cast("array<string>")), lambda v: v.isNotNull()).alias("domains"), F.get("hopaddresses", F.lit(0)).alias("origin"))
    return evaluate.thread_hijack(m)


@query(f"SELECT o_orderkey, rf / 100 > {evaluate.cost_threshold(20, 1)} AS block, rf / 100 > {evaluate.cost_threshold(1, 1)} AS alert FROM ({_SCORED})")
def d11_cost_threshold(spark: SparkSession, d: str) -> DataFrame:
    risk = F.col("risk_final") / 100
    return analysis.scored(spark, d).select("o_orderkey", (risk > evaluate.cost_threshold(20, 1)).alias("block"), (risk > evaluate.cost_threshold(1, 1)).alias("alert"))


@query(f"""SELECT id, round(margin, 6) AS margin, round(priority, 6) AS priority FROM (SELECT o_orderkey AS id, margin, 0.5 * (1 - margin) + 0.3 * (1 - {_COVER}) + 0.2 * (1 - p[1]) AS priority FROM (SELECT *, list_position(p, list_max(p)) AS k, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin FROM ({_SCORED})))
    ORDER BY round(priority, 9) DESC, id LIMIT 100""")
def d12_labelling_queue(spark: SparkSession, d: str) -> DataFrame:
    q = evaluate.labelling_queue(analysis.scored(spark, d).withColumnRenamed("o_orderkey", "id"))
    return q.select("id", *_r("margin", "priority"))


@query(f"SELECT a AS only_first, b AS only_second, round(CASE WHEN a + b > 0 THEN (a - b) * (a - b) / (a + b) ELSE 0 END, 6) AS chi2 FROM (SELECT count(*) FILTER (WHERE predicted = truth AND other <> truth) AS a, count(*) FILTER (WHERE predicted <> truth AND other = truth) AS b FROM (SELECT *, CASE WHEN s > 0.5 THEN 'N' ELSE 'A' END AS other FROM {_EV}))")
def d13_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d).withColumn("other", F.when(F.col("s") > 0.5, "N").otherwise("A"))
    return evaluate.mcnemar(v, "truth", "predicted", "other").select("only_first", "only_second", *_r("chi2"))


_AGE = "CAST(floor(((SELECT max(createdat) FROM cases) - createdat) / 86400000) AS BIGINT)"
_MASKED = "regexp_replace(regexp_replace(regexp_replace({}, '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[EMAIL_REDACTED]', 'g'), '(\\+\\d{{1,3}}[- ]?)?\\d{{10}}|(\\d{{3}}[- .]\\d{{3}}[- .]\\d{{4}})', '[PHONE_REDACTED]', 'g'), '\\b(?:\\d[ -]*?){{13,16}}\\b', '[CARD_REDACTED]', 'g')"


@query(f"SELECT case_no, CASE WHEN coalesce({_AGE} > 180, false) THEN 'older than 180 days' END AS rule, CASE WHEN coalesce({_AGE} > 180, false) THEN {_AGE} END AS age_days, CASE WHEN NOT coalesce({_AGE} > 180, false) THEN {_MASKED.format('subject')} END AS subject FROM cases")
def d14_retention(spark: SparkSession, d: str) -> DataFrame:
    """What is read of every case 180 days before the last one, and the tombstones of the others."""
    c = table(spark, d, "cases")
    now = c.agg(F.max("createdat").alias("_now"))  # one row
    kept, gone = evaluate.retention(c.crossJoin(F.broadcast(now)), F.col("_now"), 180)
    none = lambda t: F.lit(None).cast(t)
    return kept.select("case_no", none("string").alias("rule"), none("bigint").alias("age_days"), "subject").unionByName(gone.select("case_no", "rule", "age_days", none("string").alias("subject")))
