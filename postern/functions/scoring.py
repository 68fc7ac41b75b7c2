"""The explainable scoring model as columns: logits, softmax, noisy-or, confidence, bands.

A feature is a nullable double: NULL means unobserved and adds exactly 0. `score` works in steps of
plain columns, so that every intermediate value is computed once inside one generated stage, without
joins: where a class's weights are equal inside a family and can't be clipped, a logit is the six
family sums times six weights. `logits` and `softmax` are the same as single expressions over arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions.text import c
from postern.session import let


def quarantine(value) -> Column:
    """A feature value outside [0, 1] or not finite becomes unobserved, never clamped."""
    v = c(value).cast("double")
    return F.when(~F.isnan(v) & v.between(0.0, 1.0), v)


def family_index() -> list[int]:
    """Family number of every feature in vector order."""
    return [i for i, names in enumerate(L.FAMILIES.values()) for _ in names]


def weights() -> list[list[float]]:
    """Per class, the weight of each feature: the family's weight shared by its features."""
    sizes = [len(n) for n in L.FAMILIES.values()]
    return [[L.FAMILY_WEIGHTS[k][f] / sizes[f] for f in family_index()] for k in L.CLASSES]


@dataclass(frozen=True)
class Model:
    """Weights of the class model and the second head; the defaults are the hand-set ones."""

    b0: list[float] = field(default_factory=lambda: list(L.INTERCEPTS))
    beta: list[list[float]] = field(default_factory=weights)
    g0: float = L.BEC_INTERCEPT
    g: dict[str, float] = field(default_factory=lambda: dict(L.BEC_WEIGHTS))
    gamma: float = L.GAMMA
    temperature: float = 1.0
    tau_high: float = 60.0
    tau_susp: float = 40.0
    weights_source: str = "hand_set_uncalibrated"

    def family_weights(self) -> list[list[float]] | None:
        """Per class the weight of each family, if it is shared inside families and no term can be clipped."""
        fam = family_index()
        out = [[row[fam.index(f)] for f in range(len(L.FAMILIES))] for row in self.beta]
        shared = all(row[i] == out[k][f] and abs(row[i]) <= L.CLIP for k, row in enumerate(self.beta) for i, f in enumerate(fam))
        return out if shared else None


def score(df: DataFrame, x: str = "x", model: Model | None = None, evidence: str | None = None) -> DataFrame:
    """Adds z, p (arrays of 8), top, risk, bec, risk_final, confidence, band, verdict and automatic; columns of these names are replaced.

    `x` is the vector array<double>[60]; a null vector gives NULLs, another length is an error.
    `evidence`: optional array of further independent probabilities. Automation (`automatic`) needs
    fitted weights and a determined verdict.
    """
    m = model or Model()
    whole = F.when(F.col(x).isNull() | (F.size(x) == len(L.FEATURES)), F.col(x)).otherwise(F.raise_error(F.lit(f"a vector has {len(L.FEATURES)} features")))
    v = lambda i: F.coalesce(F.get("_x", F.lit(i)), F.lit(0.0))
    total = lambda cols: sum(cols[1:], cols[0])
    family = m.family_weights()
    df = df.withColumn("_x", whole)
    if family:
        fam = family_index()
        df = df.withColumns({f"_f{f}": total([v(i) for i in range(len(fam)) if fam[i] == f]) for f in range(len(L.FAMILIES))})
        z = [total([F.lit(b), *[w * F.col(f"_f{f}") for f, w in enumerate(row)]]) for b, row in zip(m.b0, family, strict=True)]
    else:
        df = df.withColumn("_v", F.transform("_x", lambda e: F.coalesce(e, F.lit(0.0))))
        z = [F.aggregate(F.zip_with(_literals(row), F.col("_v"), term), F.lit(float(b)), lambda acc, t: acc + t) for b, row in zip(m.b0, m.beta, strict=True)]
    k = range(len(L.CLASSES))
    df = df.withColumns({f"_z{i}": F.when(F.col("_x").isNotNull(), z[i]) for i in k} | {"_g": F.when(F.col("_x").isNotNull(), total([F.lit(m.g0), *[g * v(L.FEATURES.index(n)) for n, g in m.g.items()]]))})
    df = df.withColumn("_top", F.greatest(*[F.col(f"_z{i}") for i in k]))
    df = df.withColumns({f"_e{i}": F.exp(F.col(f"_z{i}") - F.col("_top")) for i in k})
    df = df.withColumn("_sum", total([F.col(f"_e{i}") for i in k]))
    df = df.withColumns({f"_p{i}": F.col(f"_e{i}") / F.col("_sum") for i in k} | {"bec": sigmoid(F.col("_g") / max(1e-6, m.temperature))})
    p = [F.col(f"_p{i}") for i in k]
    first = F.when(F.col("_top").isNull(), F.lit(None))
    for i in k:
        first = first.when(F.col(f"_z{i}") == F.col("_top"), i)
    entropy = total([F.when(q > 0, -q * F.log(q)).otherwise(0.0) for q in p])
    known = lambda c: F.when(F.col("_top").isNotNull(), c)
    extra = F.col("bec") if evidence is None else 1.0 - (1.0 - F.col("bec")) * (1.0 - L.W_BEC * noisy_or(evidence))
    df = df.withColumns({
        "z": known(F.array(*[F.col(f"_z{i}") for i in k])), "p": known(F.array(*p)), "top": first.cast("int"), "risk": 100.0 * (1.0 - p[0]), "risk_final": 100.0 * (1.0 - p[0] * (1.0 - L.W_BEC * extra)),
        "confidence": F.when(F.col("_top").isNotNull(), F.pow(F.greatest(F.lit(0.0), 1.0 - entropy / F.log(F.lit(8.0))), F.lit(m.gamma))),
    })
    df = df.withColumns({"band": F.when(F.col("risk_final").isNotNull(), F.when(F.col("risk_final") >= m.tau_high, "HIGH-RISK").when(F.col("risk_final") >= m.tau_susp, "SUSPICIOUS").otherwise("LOW")), "verdict": F.when(F.col("confidence").isNotNull(), abstention("confidence"))})
    df = df.withColumn("automatic", F.lit(m.weights_source == "fitted") & (F.col("verdict") == "DETERMINED") & (F.col("band") == "HIGH-RISK"))
    hidden = ["_x", "_v", "_g", "_top", "_sum", *[f"_{c}{i}" for c in "fzep" for i in k]]
    return df.drop(*hidden)


def term(weight: Column, value: Column) -> Column:
    """A feature's clipped contribution; unobserved adds 0."""
    raw = weight * F.coalesce(value, F.lit(0.0))
    return F.greatest(F.lit(-L.CLIP), F.least(F.lit(L.CLIP), raw))


def _literals(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def logits(x) -> Column:
    """array<double>[8] from the nullable vector array<double>[60]."""

    def of(values: Column) -> Column:
        out = []
        for b, w in zip(L.INTERCEPTS, weights(), strict=True):
            # A vector lies in [0, 1]; where no weight exceeds the clip, clipping can't change a term.
            each = (lambda a, v: a * v) if max(map(abs, w)) <= L.CLIP else term
            out.append(F.aggregate(F.zip_with(_literals(w), values, each), F.lit(b), lambda acc, v: acc + v))
        return F.array(*out)

    return let(F.transform(c(x), lambda v: F.coalesce(v, F.lit(0.0))), of)


def softmax(z) -> Column:
    """Shifted by the maximum, so large logits stay finite; every step is evaluated once per row."""

    def share(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda v: v / total))

    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda top: let(F.transform(v, lambda u: F.exp(u - top)), share))

    return let(c(z), shifted)


def sigmoid(v) -> Column:
    return 1.0 / (1.0 + F.exp(-c(v)))


def clamp01(v) -> Column:
    return F.when(c(v).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(v))))


def noisy_or(values) -> Column:
    """1 - prod(1 - v), each v clamped to [0, 1]; no values give 0; a NaN gives NULL."""
    bad = F.exists(c(values), lambda v: F.isnan(v))
    return F.when(~bad, 1.0 - F.aggregate(c(values), F.lit(1.0), lambda acc, v: acc * (1.0 - clamp01(F.coalesce(v, F.lit(0.0))))))


def argmax(p) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(c(p), F.array_max(c(p))) - 1).cast("int")


def risk(p) -> Column:
    return 100.0 * (1.0 - F.element_at(c(p), 1))


def bec_score(x, temperature: float = 1.0) -> Column:
    z = F.lit(L.BEC_INTERCEPT)
    for name, g in L.BEC_WEIGHTS.items():
        z = z + g * F.coalesce(F.element_at(c(x), L.FEATURES.index(name) + 1), F.lit(0.0))
    return sigmoid(z / max(1e-6, temperature))


def blended(p_not_legit: Column, bec: Column) -> Column:
    return 1.0 - (1.0 - p_not_legit) * (1.0 - L.W_BEC * bec)


def risk_final(p, bec, evidence=None) -> Column:
    """Risk of the class model and the blend of the second head with further evidence."""
    not_legit = 1.0 - F.element_at(c(p), 1)
    extra = c(bec) if evidence is None else 1.0 - (1.0 - c(bec)) * (1.0 - L.W_BEC * noisy_or(evidence))
    return 100.0 * (1.0 - (1.0 - not_legit) * (1.0 - L.W_BEC * extra))


def model_confidence(p) -> Column:
    """(1 - entropy / ln 8) to the power gamma."""
    h = F.aggregate(c(p), F.lit(0.0), lambda acc, v: acc - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    return F.pow(F.greatest(F.lit(0.0), 1.0 - h / F.log(F.lit(8.0))), F.lit(L.GAMMA))


def geometric_confidence(t, s, a, x) -> Column:
    """T^.35 S^.25 (1-A)^.25 X^.15, capped; any zero factor gives 0."""
    parts = [(c(t), 0.35), (c(s), 0.25), (1.0 - c(a), 0.25), (c(x), 0.15)]
    out = F.lit(1.0)
    for v, e in parts:
        out = out * F.pow(clamp01(v), F.lit(e))
    return F.when(out.isNotNull(), F.least(out, F.lit(L.CONFIDENCE_CAP)))


def band(risk_final_) -> Column:
    return F.when(c(risk_final_) >= 60, "HIGH-RISK").when(c(risk_final_) >= 40, "SUSPICIOUS").otherwise("LOW")


def abstention(confidence) -> Column:
    return F.when(c(confidence) < 0.5, "UNDETERMINED").when(c(confidence) < 0.7, "LOW_CONFIDENCE_REVIEW_ADVISED").otherwise("DETERMINED")


def attribution_band(value) -> Column:
    return F.when(c(value) >= 0.70, "STRONG").when(c(value) >= 0.45, "MODERATE").when(c(value) >= 0.25, "WEAK").otherwise("INSUFFICIENT")


def age_ramp(days) -> Column:
    return F.when(c(days) >= 0, 1.0 - F.least(F.log1p(c(days)) / F.log(F.lit(3651.0)), F.lit(1.0)))


def coverage(x, k: int) -> Column:
    """Share of a class's absolute weight that lies on observed features."""
    w = [abs(v) for v in weights()[k]]
    seen = F.aggregate(F.zip_with(_literals(w), c(x), lambda a, v: F.when(v.isNotNull(), a).otherwise(0.0)), F.lit(0.0), lambda p, q: p + q)
    return seen / sum(w)


def findings(x, k) -> Column:
    """array<struct<pos, contribution>> of class k (a column), non-zero, largest absolute first, ties in vector order."""
    table = F.array(*[_literals(w) for w in weights()])
    terms = let(F.get(table, c(k)), lambda w: F.zip_with(w, c(x), term))
    numbered = F.filter(F.transform(terms, lambda v, i: F.struct((-F.abs(v)).alias("rank"), i.alias("pos"), v.alias("contribution"))), lambda s: s["contribution"] != 0)
    return F.transform(F.array_sort(numbered), lambda s: F.struct(s["pos"].alias("pos"), s["contribution"].alias("contribution")))
