"""Evaluation of scored rows: confusion metrics, curves, calibration, thresholds, comparison, labelling, retention."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import scoring, text


def per_class(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(class, support, precision, recall, f1) from (truth, predicted); undefined ratios are 0."""
    cm = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col(truth).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    long = cm.select("n", (F.col(truth) == F.col(predicted)).alias("hit"), F.explode(both).alias("x"))
    g = long.groupBy(F.col("x.k").alias("class")).agg(
        F.sum(F.col("n") * F.col("x.t")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("said"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("tp")
    )
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return g.select("class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def overall(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy (which is micro F1 as well), macro_f1 and balanced_accuracy over the classes that occur."""
    cm = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    a = cm.agg((F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    m = per_class(df, truth, predicted).filter("support > 0").agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    return a.crossJoin(m)


def binary(df: DataFrame, score: str, label: str, tau: float) -> DataFrame:
    """One row: tp, fp, tn, fn, mcc, fpr, tpr of score >= tau."""
    y, s = F.col(label) == 1, F.col(score) >= tau
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    d = df.agg(n(y & s).alias("tp"), n(~y & s).alias("fp"), n(~y & ~s).alias("tn"), n(y & ~s).alias("fn"))
    den = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return d.select(
        "tp", "fp", "tn", "fn", F.when(den > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / den).otherwise(0.0).alias("mcc"),
        F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("tpr"),
    )


def curve(df: DataFrame, score: str, label: str, bins: int = 10_000) -> DataFrame:
    """(score, tp, fp, n_pos, n_neg) cumulated from the highest score; one point per distinct score.

    Equal scores are counted together before the cumulative sum, so ties are one step. Scores are
    counted per distinct value first; the running sums go over range blocks with their offsets.
    """
    s = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    blocks = s.withColumn("blk", F.floor(F.col("score") * bins))
    sums = blocks.groupBy("blk").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))  # at most `bins` rows for scores in 0..1
    w = Window.orderBy(F.col("blk").desc())
    before = sums.select("blk", (F.sum("bp").over(w) - F.col("bp")).alias("p0"), (F.sum("bn").over(w) - F.col("bn")).alias("n0"), F.sum("bp").over(Window.partitionBy(F.lit(0))).alias("n_pos"), F.sum("bn").over(Window.partitionBy(F.lit(0))).alias("n_neg"))
    inside = Window.partitionBy("blk").orderBy(F.col("score").desc())
    cum = blocks.select("score", "blk", F.sum("p").over(inside).alias("cp"), F.sum("n").over(inside).alias("cn"))
    return cum.join(before, "blk").select("score", "blk", (F.col("p0") + F.col("cp")).alias("tp"), (F.col("n0") + F.col("cn")).alias("fp"), "n_pos", "n_neg")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: roc_auc and pr_auc, trapezoids over the points of curve(); ties are one step.

    The precision before the first point is that of the first point. The step before a point lies in
    its own block of scores or is the last one of the blocks above.
    """
    s = curve(df, score, label)
    inside = Window.partitionBy("blk").orderBy(F.col("score").desc())
    ends = s.groupBy("blk").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))  # at most as many rows as blocks
    above = Window.orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("blk", F.coalesce(F.max("tp").over(above), F.lit(0)).alias("tp_b"), F.coalesce(F.max("fp").over(above), F.lit(0)).alias("fp_b"))
    x = s.withColumns({"t": F.lag("tp").over(inside), "f": F.lag("fp").over(inside)}).join(before, "blk")
    t0, f0 = F.coalesce("t", "tp_b"), F.coalesce("f", "fp_b")
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    was = F.when(t0 + f0 > 0, t0 / (t0 + f0)).otherwise(now)
    roc = F.try_divide(F.sum((F.col("fp") - f0) * (F.col("tp") + t0) / 2.0), F.max(F.col("n_pos") * F.col("n_neg")))
    pr = F.try_divide(F.sum((F.col("tp") - t0) * (now + was) / 2.0), F.max("n_pos"))
    return x.agg(roc.alias("roc_auc"), pr.alias("pr_auc"))  # NULL without both classes


def recall_at_fpr(df: DataFrame, score: str, label: str, rate: float = 0.001) -> DataFrame:
    """One row: the recall at the least threshold whose false-positive rate is at most `rate`; 0 if there is none."""
    return threshold_for_fpr(df, score, label, rate).select(F.coalesce("recall", F.lit(0.0)).alias("recall"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate, gap) of equal-width bins; 1.0 lies in the last one."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    return g.withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row: brier, ece, mce."""
    c = calibration(df, score, label, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    return df.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier")).crossJoin(c)


def threshold_for_fpr(df: DataFrame, score: str, label: str, cap: float) -> DataFrame:
    """One row: the least threshold whose false-positive rate stays within the cap, and its recall."""
    ok = curve(df, score, label).filter(F.col("fp") <= cap * F.col("n_neg"))
    return ok.agg(F.min(F.struct("score", F.try_divide("tp", "n_pos").alias("recall"))).alias("b")).select(F.col("b.score").alias("tau"), F.col("b.recall").alias("recall"))


def sender_baseline(df: DataFrame, key: str, order: str, value: str, least: int = 8) -> DataFrame:
    """Adds deviation of a value from its key's own past: 1 - exp(-d / 1.5), d one-sided in standard deviations.

    NULL until `least` earlier values exist.
    """
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mu, sd = F.count(value).over(past), F.avg(value).over(past), F.stddev(value).over(past)
    dev = F.greatest(F.lit(0.0), (F.col(value) - mu) / F.when(sd > 0, sd))
    return df.withColumn("deviation", F.when(n >= least, 1 - F.exp(-dev / 1.5)))


def cost_threshold(fp: float, fn: float) -> float:
    """Risk (0 to 1) above which an alert costs less than none."""
    return fp / (fp + fn)


def mcnemar(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """One row comparing two predictions: only_first and only_second right, chi2 with one degree of freedom, and p."""
    a, b = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    c = df.agg(F.count(F.when(a & ~b, 1)).alias("only_first"), F.count(F.when(b & ~a, 1)).alias("only_second"))
    x, y = F.col("only_first"), F.col("only_second")
    chi2 = F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda z: math.erfc(math.sqrt(z / 2)))

    return c.withColumn("chi2", chi2).withColumn("p", tail("chi2"))


def combined_confidence(confidence: Column, coverage: Column) -> Column:
    """A confident model on little of the evidence isn't confident."""
    return confidence * coverage


def severity(risk: Column) -> Column:
    return F.when(risk >= 80, "CRITICAL").when(risk >= 60, "HIGH").when(risk >= 40, "MEDIUM").when(risk >= 20, "LOW").otherwise("NONE")


def confident_accuracy(df: DataFrame, confidence: str, right: Column, least: float = 0.9) -> DataFrame:
    """One row: how many verdicts have at least this confidence, how many of them and of all are right."""
    high = F.col(confidence) >= least
    return df.agg(F.count(F.when(high, 1)).alias("confident"), F.avg(F.when(high, right.cast("double"))).alias("accuracy_confident"), F.avg(right.cast("double")).alias("accuracy"))


def class_coverage(x: str, top: str) -> Column:
    """Share of the chosen class's absolute weight that lies on observed features."""
    return F.get(F.array(*[scoring.coverage(x, k) for k in range(len(L.CLASSES))]), F.col(top))


def labelling_queue(df: DataFrame, most: int = 100, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """The `most` rows of score() whose labels would teach most: small margin, little evidence, severe class; ties by id.

    `df` has id, p, x, top and risk. The list is a top-k report.
    """
    p = F.sort_array("p", asc=False)
    margin = F.get(p, F.lit(0)) - F.get(p, F.lit(1))
    a, b, c = weights
    priority = a * (1.0 - margin) + b * (1.0 - class_coverage("x", "top")) + c * F.col("risk") / 100.0
    return df.select("id", margin.alias("margin"), priority.alias("priority")).orderBy(F.round("priority", 9).desc(), "id").limit(most)


REPLY = r"(?i)^(?:\s*(?:re|fwd?|aw|tr|wg)\s*:\s*)+"


def thread_hijack(mail: DataFrame) -> DataFrame:
    """(id, thread, continued, new_origin, asks, hijack) of (id, seq, subject, domains, origin).

    A thread is the subject without reply marks, in lower case, and the set of participants' domains.
    It is continued if it was seen before; its origin is new if no earlier message of the thread came
    from it; a message asks if its subject speaks of payment, a new account or urgency. Messages
    without subject are in no thread. Threads are cut at nothing: a hot thread is sorted by the
    window of one task, its first sight of an origin is a minimum combined before that.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), REPLY, ""))
    t = mail.select("id", "seq", "origin", plain.alias("plain"), F.concat_ws("|", plain, F.array_join(F.array_sort(F.array_distinct("domains")), ",")).alias("thread"), F.lower("subject").rlike(REPLY).alias("marked"))
    key = F.struct("seq", "id")
    first = t.groupBy("thread").agg(F.min(key).alias("first"))
    seen = t.filter("origin is not null").groupBy("thread", "origin").agg(F.min(key).alias("seen"))
    j = t.join(first, "thread").join(seen, ["thread", "origin"], "left")
    cues = text.cue_count(F.col("plain"), L.PAYMENT) + text.cue_count(F.col("plain"), L.CHANNEL_CHANGE)
    urgent = F.lit(False)
    for phrase, _ in L.URGENCY:
        urgent = urgent | F.contains("plain", F.lit(phrase))
    continued = (F.col("plain") != "") & F.coalesce(F.col("marked"), F.lit(False)) & (key > F.col("first"))
    new_origin = F.coalesce(key == F.col("seen"), F.lit(False))
    out = j.select("id", "thread", continued.alias("continued"), new_origin.alias("new_origin"), ((cues > 0) | urgent).alias("asks"))
    return out.withColumn("hijack", F.col("continued") & F.col("new_origin") & F.col("asks"))


def retention(cases: DataFrame, now_ms: int | Column, days: int, masked: tuple[str, ...] = ("title", "subject")) -> tuple[DataFrame, DataFrame]:
    """(rows kept, as they are read; tombstones of the rest): personal data is masked on reading only.

    A row without creation time is kept. A tombstone has the row's id, its age in days and the rule.
    """
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    age = F.floor((now - F.col("createdat")) / 86_400_000)
    old = F.coalesce(age > days, F.lit(False))
    kept = cases.filter(~old).withColumns({c: text.mask_pii(c) for c in masked})
    return kept, cases.filter(old).select("case_no", "id", age.cast("bigint").alias("age_days"), F.lit(f"older than {days} days").alias("rule"))


def hop_velocity(df: DataFrame, key: str, order: str, lat: str, lon: str) -> DataFrame:
    """Adds km, seconds and impossible (> 900 km/h within two hours) against the key's row before."""
    w = Window.partitionBy(key).orderBy(order)
    la, lo, t = F.lag(lat).over(w), F.lag(lon).over(w), F.lag(order).over(w)
    rad = F.radians
    h = F.pow(F.sin((rad(lat) - rad(la)) / 2), 2) + F.cos(rad(la)) * F.cos(rad(lat)) * F.pow(F.sin((rad(lon) - rad(lo)) / 2), 2)
    km = 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    sec = F.unix_seconds(F.col(order)) - F.unix_seconds(t)
    return df.withColumns({"km": km, "seconds": sec, "impossible": (sec > 0) & (sec < 7200) & (km / sec * 3600 > 900)})


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int = 1000) -> DataFrame:
    """One row: mean and its 2.5 % and 97.5 % bounds from Poisson resampling seeded by hash.

    Each row's weight in a round is Poisson(1) from a hash of its key and the round, so every executor
    draws the same. A task weighs its rows for all rounds at once and hands on one sum per round, so
    rows are never multiplied and the shuffle holds `rounds` rows a task. NULL values don't count.
    """
    # Cumulated Poisson(1) probabilities; more than 7 has a probability of a hundred-thousandth.
    cut = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weights, values = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            v, h = b["v"].to_numpy(dtype=float), b["h"].to_numpy().astype(np.uint64)
            for i in range(0, len(v), 500):
                x = h[i : i + 500, None] + turn[None, :]
                for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(mix)
                w = np.searchsorted(cut, (x ^ (x >> np.uint64(31))) / 2.0**64)
                weights += w.sum(axis=0)
                values += v[i : i + 500] @ w
        yield pd.DataFrame({"r": np.arange(rounds), "sv": values, "sw": weights})

    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)  # a small file is one task else
    m = rows.mapInPandas(run, "r int, sv double, sw double").groupBy("r").agg((F.sum("sv") / F.nullif(F.sum("sw"), F.lit(0.0))).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
