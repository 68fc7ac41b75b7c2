"""Fitting the class model offline: ridge multinomial regression with class weights, then its temperature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import scoring
from postern.session import materialize


def split(df: DataFrame, key: str = "id", seed: int = 7) -> dict[str, DataFrame]:
    """Rows as train (70), validation (15) and test (15 %), by a hash of the key, so that every run draws the same."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return {"train": df.filter(h < 70), "validation": df.filter(h.between(70, 84)), "test": df.filter(h >= 85)}


def fit(df: DataFrame, ridge: float = 1e-3, most: int = 100, seed: int = 7) -> tuple[scoring.Model, dict[str, float]]:
    """A fitted scoring.Model and its figures, from (id, label 0..7, x array<double>[60]).

    Unobserved features add nothing, as in scoring. Classes weigh N / (K n_k). The temperature is
    the one of a grid that gives the least loss on the validation part; it divides the weights, so
    scoring needs no further parameter. Data stays on the executors; per iteration one gradient of
    8 x 61 numbers comes to the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = materialize(df.select("id", "label", "x"), "fit")  # read in every iteration
    parts = split(rows.filter("label is not null and x is not null"), seed=seed)
    dense = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    train = parts["train"].select(F.col("label").cast("double").alias("label"), array_to_vector(dense).alias("features"))
    n = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 8 rows
    if not n:
        raise ValueError("no labelled rows to fit")
    weight = F.create_map(*[F.lit(v) for k, c in n.items() for v in (float(k), sum(n.values()) / (len(n) * c))])
    lr = LogisticRegression(family="multinomial", regParam=ridge, elasticNetParam=0.0, maxIter=most, tol=1e-6, standardization=True, weightCol="w")
    m = lr.fit(train.withColumn("w", F.element_at(weight, F.col("label"))))
    k = len(L.CLASSES)
    rows, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    beta = [[float(v) for v in rows[i]] if i < len(rows) else [0.0] * len(L.FEATURES) for i in range(k)]
    # A class that doesn't occur gets no mass.
    b0 = [float(b[i]) if i < len(b) and i in n else -30.0 for i in range(k)]
    z = scoring.score(parts["validation"], model=scoring.Model(b0, beta, weights_source="fitted")).select("label", "z")
    grid = [0.5 * 1.1**i for i in range(20)]
    loss = lambda t: F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max("z")) / t))) - (F.get("z", F.col("label").cast("int")) - F.array_max("z")) / t)
    losses = z.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    best = min(range(len(grid)), key=lambda i: math.inf if losses[i] is None else losses[i])
    t = grid[best]
    model = scoring.Model([v / t for v in b0], [[v / t for v in row] for row in beta], weights_source="fitted")
    right = scoring.score(parts["test"], model=model).agg(F.avg((F.col("top") == F.col("label")).cast("double")).alias("a")).first()["a"]
    return model, {"temperature": t, "validation_loss": losses[best], "test_accuracy": right}
