"""Batch inference: the one way in which a model's parameters meet rows.

The parameters (probe weights, pooling projections, class centroids) are read
once from a one-row table and travel inside the prediction function, which
Spark broadcasts to the executors and each Python worker loads once. Rows are
scored in Arrow batches with numpy matrix products, whatever the model's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 1024


def one_row(params: DataFrame) -> dict:
    """The single row of a parameter table."""
    rows = params.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a parameter table has exactly one row, got {len(rows)}")
    return rows[0].asDict(recursive=True)


def infer(
    df: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    vector: str,
    dim: int,
    out: str,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Add ``out``: ``predict`` maps a batch ``(n, dim)`` to ``(n, m)``."""
    udf = predict_batch_udf(
        lambda: predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_rows, input_tensor_shapes=[[dim]]
    )
    return df.withColumn(out, udf(F.col(vector)))
