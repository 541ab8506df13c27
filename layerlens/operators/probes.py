"""Probe classifiers on pooled vectors.

* fitting (M6) uses Spark ML — ``MultilayerPerceptronClassifier`` or
  multinomial ``LogisticRegression``; parity with the reference probe is of
  purpose, not of weights (different activation/regulariser, SURVEY O2);
* scoring with stored weights (M7) is the forward pass of both probe heads
  by batch inference, at any size;
* predictions (M10) are ``(logits, label)`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.operators.inference import BATCH_ROWS, infer, one_row

LAYER_NORM_EPS = 1e-5


def features(df: DataFrame, vector: str = "vector", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector)))


def probe_estimator(kind: str, input_dim: int, num_classes: int, hidden_dim: int = 256, seed: int = 42, max_iter: int = 100,
                    reg_param: float = 0.1):
    """M6: ``'mlp'`` (one hidden layer) or ``'logreg'`` (multinomial, with an
    L2 penalty ``reg_param`` standing in for the reference probe's dropout and
    early stopping — an unpenalised fit on the first, tiny portions is
    overconfident and its code length exceeds the uniform code)."""
    if kind == "mlp":
        return MultilayerPerceptronClassifier(
            layers=[input_dim, hidden_dim, num_classes], seed=seed, maxIter=max_iter,
            featuresCol="features", labelCol="label",
        )
    if kind == "logreg":
        return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg_param,
                                  featuresCol="features", labelCol="label")
    raise ValueError(kind)


def predict(model, df: DataFrame, keep: Sequence[str] = ("id",), label: str = "label") -> DataFrame:
    """``(keep…, logits, label, pred)`` from a fitted Spark ML model."""
    out = model.transform(df)
    return out.select(
        *keep,
        vector_to_array(F.col("rawPrediction")).alias("logits"),
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("pred"),
    )


def _numpy_forward(p: dict, kind: str):
    """The forward pass over a numpy batch ``(N, d) → (N, C)``."""
    w = {c: np.asarray(v, dtype=np.float64) for c, v in p.items()}

    def predict(x):
        x = np.asarray(x, dtype=np.float64)
        if kind == "tenney":
            h = np.tanh(x @ w["w1"].T + w["b1"])
            mu = h.mean(axis=1, keepdims=True)
            var = ((h - mu) ** 2).mean(axis=1, keepdims=True)
            h = (h - mu) / np.sqrt(var + LAYER_NORM_EPS) * w["gamma"] + w["beta"]
        else:
            h = np.maximum(x @ w["w1"].T + w["b1"], 0.0)
            h = np.maximum(h @ w["wh"].T + w["bh"], 0.0)
        return h @ w["w2"].T + w["b2"]

    return predict


def score_with_weights(df: DataFrame, params: DataFrame, kind: str = "tenney", vector: str = "vector",
                       batch_rows: int = BATCH_ROWS) -> DataFrame:
    """M7: logits of stored probe weights for every row, by batch inference.
    ``params`` is one row of weight arrays: ``w1 b1 gamma beta w2 b2``
    (``tenney``: Linear, Tanh, LayerNorm, Linear) or ``w1 b1 wh bh w2 b2``
    (``hewitt``: Linear, ReLU, Linear, ReLU, Linear); dropout is the identity."""
    if kind not in ("tenney", "hewitt"):
        raise ValueError("kind is 'tenney' or 'hewitt'")
    value = one_row(params)
    return infer(df, _numpy_forward(value, kind), vector, len(value["w1"][0]), "logits", batch_rows)


def params_from_rule(spark: SparkSession, input_dim: int, hidden_dim: int, num_classes: int, kind: str = "tenney") -> DataFrame:
    """Deterministic weights from an integer rule (exact in any engine), used
    for checking the forward pass: ``w[i][j] = (((i·7 + j·3) mod 11) - 5)/10``."""
    def mat(rows, cols, salt):
        return [[(((i * 7 + j * 3 + salt) % 11) - 5) / 10.0 for j in range(cols)] for i in range(rows)]

    def vec(n, salt):
        return [(((i * 5 + salt) % 7) - 3) / 10.0 for i in range(n)]

    if kind == "tenney":
        row = {
            "w1": mat(hidden_dim, input_dim, 0), "b1": vec(hidden_dim, 0),
            "gamma": [1.0 + i / 10.0 for i in range(hidden_dim)], "beta": vec(hidden_dim, 1),
            "w2": mat(num_classes, hidden_dim, 1), "b2": vec(num_classes, 2),
        }
    else:
        row = {
            "w1": mat(hidden_dim, input_dim, 0), "b1": vec(hidden_dim, 0),
            "wh": mat(hidden_dim, hidden_dim, 2), "bh": vec(hidden_dim, 1),
            "w2": mat(num_classes, hidden_dim, 1), "b2": vec(num_classes, 2),
        }
    cols = list(row)
    schema = ", ".join(f"{c} {'array<array<double>>' if c.startswith('w') else 'array<double>'}" for c in cols)
    return spark.createDataFrame([tuple(row[c] for c in cols)], schema)
