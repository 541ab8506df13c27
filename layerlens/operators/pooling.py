"""Hidden states, embeddings and span pooling.

Hidden states are a long table ``(seq, layer, pos, vector)``; stored
partitioned by ``layer`` so that probing one layer (M3) reads one folder.
Span pooling joins spans to tokens on the sequence key plus the range
``a <= pos < b`` (J5: the equi key keeps it a hash join, not a nested loop),
scores tokens with per-slot projection parameters, and takes the
softmax-weighted mean per span with ``Summarizer`` (weights
``exp(s - max_span s)``; the weighted mean of the projected vectors equals
the softmax-weighted sum). Aggregations are partial, so one long span or a
hot sequence does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from layerlens.operators.inference import one_row

# Default sizes of the random-embedding baseline model.
RANDOM_EMBEDDING_VOCAB = 30522
RANDOM_EMBEDDING_DIM = 768


def _uniform(*parts: Column) -> Column:
    """Deterministic uniform value in [-1, 1) from md5 of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    return h.cast("double") / float(1 << 32) * 2.0 - 1.0


def random_vector(token_id: Column, dim: int, seed: int = 42) -> Column:
    """M1: the fixed random vector of a token id (no table needed)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: _uniform(F.lit(seed), token_id, d))


def random_embedding_table(spark: SparkSession, vocab_size: int = RANDOM_EMBEDDING_VOCAB,
                           dim: int = RANDOM_EMBEDDING_DIM, seed: int = 42) -> DataFrame:
    """M1 as a table ``(token_id, vector)`` of ``vocab_size`` rows."""
    return spark.range(vocab_size).select(
        F.col("id").alias("token_id"), random_vector(F.col("id"), dim, seed).alias("vector")
    )


def lookup_embeddings(tokens: DataFrame, table: DataFrame, token: str = "token_id") -> DataFrame:
    """Token id → embedding row. Spark broadcasts the table where it has
    measured it to be small, and else splits partitions of frequent tokens."""
    return tokens.join(table.withColumnRenamed("token_id", token), token, "left")


def select_layer(hidden: DataFrame, layer: int) -> DataFrame:
    """M3: the probed layer (partition pruning on layer-partitioned data)."""
    return hidden.filter(F.col("layer") == layer)


def write_hidden_states(hidden: DataFrame, path: str, mode: str = "overwrite") -> None:
    """M8: materialise hidden states once, one folder per layer, so every
    probe, portion and sweep point reads the frozen features."""
    hidden.write.mode(mode).partitionBy("layer").parquet(path)


def extract_hidden_states(df: DataFrame, make_predict_fn: Callable, input_col: str, dim: int,
                          batch_size: int = 64, element_type: T.DataType = T.FloatType()) -> DataFrame:
    """M2: batch inference with a user model (``make_predict_fn`` returns a
    function from a numpy batch to a numpy batch of vectors)."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(element_type), batch_size=batch_size,
                            input_tensor_shapes=[[]])
    return df.withColumn("vector", udf(F.col(input_col)))


def random_embedding_model(vocab_size: int, dim: int, seed: int = 42) -> Callable:
    """M2 model loader for ``predict_batch_udf``: the random-embedding subject
    model as a numpy matrix (built once per worker from the same md5 rule as
    ``random_vector``); ``predict`` maps a batch of token ids to vectors."""

    def make_predict_fn():
        import hashlib

        table = np.empty((vocab_size, dim), dtype=np.float64)
        for t in range(vocab_size):
            for d in range(dim):
                h = int(hashlib.md5(f"{seed}:{t}:{d}".encode()).hexdigest()[:8], 16)
                table[t, d] = h / float(1 << 32) * 2.0 - 1.0

        def predict(ids):
            return table[ids.astype(np.int64)]

        return predict

    return make_predict_fn


def projection_params(spark: SparkSession, input_dim: int, hidden_dim: int, slots: int = 2) -> DataFrame:
    """Per span slot ``k``: projection ``w`` (hidden × input), bias ``b`` and
    attention vector ``v`` from an integer rule (exact in any engine)."""
    rows = []
    for k in range(slots):
        w = [[(((r * 7 + d * 3 + k) % 11) - 5) / 10.0 for d in range(input_dim)] for r in range(hidden_dim)]
        b = [(((r * 5 + k) % 7) - 3) / 10.0 for r in range(hidden_dim)]
        v = [(((r * 3 + k) % 5) - 2) / 10.0 for r in range(hidden_dim)]
        rows.append((k, w, b, v))
    return spark.createDataFrame(rows, "slot int, w array<array<double>>, b array<double>, v array<double>")


def span_tokens(tokens: DataFrame, spans: DataFrame, seq: str = "seq") -> DataFrame:
    """Tokens inside each span ``a <= pos < b`` (equi key ``seq``)."""
    t = tokens.select(F.col(seq).alias("_seq"), "pos", "vector")
    cond = (F.col(seq) == F.col("_seq")) & (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))
    return spans.join(t, cond).drop("_seq")


def attention_pool(tokens: DataFrame, spans: DataFrame, params: DataFrame, slot: int,
                   keys: Sequence[str] = ("seq", "target_idx"), seq: str = "seq") -> DataFrame:
    """M4 (card C4): ``(keys…, pooled array<double>)``; an empty span pools
    to the zero vector.

    Tokens are projected, scored and summed where the join has put them: for
    each span and Arrow batch one row goes on, with the largest score, the sum
    of the weights below it and the weighted sum. Those few rows meet by span
    and are added up on a common scale, so no token and no projected vector is
    shuffled after the join, and none at all if the tokens are stored in
    buckets of their sequences (``sequences.store_states``)."""
    keys = list(keys)
    p = one_row(params.filter(F.col("slot") == slot).select("w", "b", "v"))
    w, b, v = (np.asarray(p[c], dtype=np.float64) for c in ("w", "b", "v"))
    width = len(b)
    joined = span_tokens(tokens, spans, seq).select(*keys, F.col("vector").cast("array<double>").alias("vector"))
    fields = [joined.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("_m", T.DoubleType()), T.StructField("_w", T.DoubleType()),
                           T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):  # numbered anew each time, so that codes stay small
                own = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[order]
            h = x @ w.T + b
            score = h @ v
            top = np.maximum.reduceat(score, first)
            weight = np.exp(score - np.repeat(top, np.diff(np.r_[first, len(score)])))
            sums = np.add.reduceat(weight[:, None] * h, first, axis=0)
            ends = pa.array(np.arange(len(first) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(order[first])) for i in range(len(keys))], pa.array(top),
                 pa.array(np.add.reduceat(weight, first)), pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)))],
                schema=to_arrow_schema(schema),
            )

    j = joined.mapInArrow(partial, schema)
    scale = F.exp(F.col("_m") - F.max("_m").over(Window.partitionBy(*keys)))
    # the mean of the partial means, weighted by what they stand for
    j = j.select(*keys, F.transform("_s", lambda x: x / F.col("_w")).alias("_h"), (scale * F.col("_w")).alias("_w"))
    pooled = j.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col("_h")), F.col("_w")).alias("_p"),
    ).select(*keys, vector_to_array("_p").alias("pooled"))
    out = spans.select(*keys).join(pooled, keys, "left")
    return out.select(*keys, F.coalesce(F.col("pooled"), F.array_repeat(F.lit(0.0), width)).alias("pooled"))


def pair_concat(pooled1: DataFrame, pooled2: DataFrame, keys: Sequence[str] = ("seq", "target_idx")) -> DataFrame:
    """M5: ``concat(pooled span1, pooled span2)`` per target."""
    keys = list(keys)
    a = pooled1.withColumnRenamed("pooled", "_p1")
    b = pooled2.withColumnRenamed("pooled", "_p2")
    return a.join(b, keys).select(*keys, F.concat("_p1", "_p2").alias("pooled"))
