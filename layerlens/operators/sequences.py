"""Hidden states of whole sequences (M2), stored so that pooling moves no
token (M8, J5, M4).

``extract_states`` runs a user's model over sequences of token ids, type ids
and masks. In a task the sequences of a window are sorted by length and put
together while their padded size stays within a bound, so a batch holds
sequences of like length and little padding, and a long sequence makes a small
batch. Every layer and position is a row.

``store_states`` writes states as a table bucketed and sorted by sequence, one
folder a layer. Spans that meet tokens on the sequence, and what is summed per
span then, use the buckets as they are: the token side has no exchange.

Defined cases: a sequence without tokens has no states; a missing mask means
all tokens count; positions outside the mask have no states; rows with equal
keys are sequences of their own and keep all their states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_TOKENS = 1 << 13  # padded tokens of a batch
WINDOW_ROWS = 1 << 12  # sequences that are sorted together


def length_batches(lengths: np.ndarray, batch_tokens: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """Positions of the sequences of each batch: sorted by length, as many as
    fit when all are padded to the longest (at least one)."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] <= batch_tokens:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _padded(flat: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(first), width), np.int64)
    column = np.arange(width)[None, :]
    there = column < length[:, None]
    out[there] = flat[(first[:, None] + column)[there]]
    return out


Predict = Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[np.ndarray]]


def extract_states(
    df: DataFrame,
    make_predict: Callable[[], Predict],
    keys: Sequence[str] = ("seq",),
    ids: str = "input_ids",
    types: str | None = "token_type_ids",
    mask: str | None = "attention_mask",
    layers: Sequence[int] | None = None,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """M2: ``keys…, layer, pos, vector``. ``make_predict()`` loads the model
    once a task and returns ``predict(ids, types, mask)``: padded matrices
    ``(n, L)`` in, for every layer an array ``(n, L, dim)`` out. ``layers``
    keeps some of them."""
    keys = list(keys)
    used = [c for c in (ids, types, mask) if c]
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("layer", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("vector", T.ArrayType(T.DoubleType()))])
    plain = df.select(*keys, *[F.col(c).cast("array<long>").alias(c) for c in used])
    n_keys = len(keys)

    def run(batches):
        predict = make_predict()
        for batch in batches:
            for lo in range(0, batch.num_rows, WINDOW_ROWS):
                part = batch.slice(lo, WINDOW_ROWS)
                lists = {c: part.column(n_keys + i) for i, c in enumerate(used)}
                length = lists[ids].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
                first = np.cumsum(length) - length
                for at in length_batches(length, batch_tokens):
                    width = int(length[at].max())
                    side = lambda c: _padded(flat[c], first[at], length[at], width)  # noqa: B023, E731
                    real = np.arange(width)[None, :] < length[at][:, None]
                    on = real & (side(mask) != 0) if mask else real
                    kind = side(types) if types else np.zeros_like(on, np.int64)
                    row, pos = np.nonzero(on)
                    held = [c.take(pa.array(at[row])) for c in part.columns[:n_keys]]
                    for layer, states in enumerate(predict(side(ids), kind, on.astype(np.int64))):
                        if layers is not None and layer not in layers:
                            continue
                        v = np.asarray(states, np.float64)[row, pos]
                        ends = pa.array(np.arange(len(v) + 1) * (v.shape[1] if len(v) else 0), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [*held, pa.array(np.full(len(v), layer, np.int32)), pa.array(pos.astype(np.int32)),
                             pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))],
                            names=[*keys, "layer", "pos", "vector"],
                        )

    return plain.mapInArrow(run, schema)


def neighbour_model(dim: int, layers: int) -> Callable[[], Predict]:
    """A model with fixed weights whose states depend on their neighbours:
    each layer is half the state, a quarter of both neighbours', and a tenth
    of the type id. For checking, as any engine can repeat it."""

    def make() -> Predict:
        def predict(ids, types, mask):
            d = np.arange(dim)
            x = (((ids[:, :, None] * 7 + d * 3) % 11) - 5) / 10.0 * mask[:, :, None]
            out = [x]
            for _ in range(layers - 1):
                left, right = np.zeros_like(x), np.zeros_like(x)
                left[:, 1:], right[:, :-1] = x[:, :-1], x[:, 1:]
                x = (x / 2 + (left + right) / 4 + types[:, :, None] / 10.0) * mask[:, :, None]
                out.append(x)
            return out

        return predict

    return make


def store_states(states: DataFrame, name: str, path: str, buckets: int, seq: str = "seq") -> DataFrame:
    """M8: states written once as a table, one folder a layer, every layer
    bucketed and sorted by sequence. ``path`` is a shared folder. Rows are
    dealt by bucket first, so that a bucket of a layer is one file."""
    spark = states.sparkSession
    dealt = states.repartition(buckets, seq)
    writer = dealt.write.partitionBy("layer").bucketBy(buckets, seq).sortBy(seq, "pos")
    writer.option("path", path).format("parquet").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def bucketed_by(spark: SparkSession, name: str) -> int:
    """Buckets of a stored table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"]) if rows else 0
