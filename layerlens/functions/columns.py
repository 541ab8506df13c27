"""Column-level helpers built only from built-in Spark SQL functions (higher
order functions on arrays), so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the split/sampling seed of the reference (kept so that the
# permutation is independent of any global seed).
SPLIT_SEED = 5823905


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(id_col: str | Column, seed: int | str = SPLIT_SEED) -> Column:
    """Deterministic shuffle key ``md5('<seed>:<id>')`` (hex). The same
    string in any engine gives the same order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(id_col).cast("string")))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def logsumexp(logits: Column) -> Column:
    """``log Σ exp(z)`` computed stably as ``m + log Σ exp(z - m)``."""
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - m)))


def softmax(logits: Column) -> Column:
    """T9 softmax over a logits array."""
    lse = logsumexp(logits)
    return F.transform(logits, lambda z: F.exp(z - lse))


def sigmoid(logits: Column) -> Column:
    """T9 element-wise sigmoid."""
    return F.transform(logits, lambda z: 1.0 / (1.0 + F.exp(-z)))


def to_probabilities(logits: Column, name: str | None) -> Column:
    """T9 dispatch: ``softmax`` / ``sigmoid`` / ``identity`` (or None)."""
    if name is None or name.lower() == "identity":
        return logits
    if name.lower() == "softmax":
        return softmax(logits)
    if name.lower() == "sigmoid":
        return sigmoid(logits)
    raise NotImplementedError(name)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum (ties → first, like torch)."""
    return F.array_position(arr, F.array_max(arr)) - 1


def last_element(arr: Column) -> Column:
    """Ranking score = probability of the last class."""
    return F.element_at(arr, -1)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Per-row cross-entropy in nats: ``logsumexp(z) - z[y]``."""
    return logsumexp(logits) - F.element_at(logits, label.cast("int") + 1)


def bucket_boundaries(num_buckets: int) -> list[float]:
    """Right-closed bucket edges ``i/(B-1)``, i = 1..B-1 (float32 later)."""
    return [i / (num_buckets - 1) for i in range(1, num_buckets)]


def bucketize(x: Column, num_buckets: int) -> Column:
    """T5: number of float32 boundaries strictly below float32(x): 0 → 0,
    exactly 1 → B-2 (so ids run 0..B-2)."""
    edges = F.array(*[F.lit(b).cast("float") for b in bucket_boundaries(num_buckets)])
    xf = x.cast("float")
    return F.aggregate(edges, F.lit(0), lambda acc, b: acc + F.when(b < xf, 1).otherwise(0))


def one_hot(label_id: Column, num_classes: int | Column) -> Column:
    """Row of the identity matrix as ``array<float>``."""
    n = num_classes if isinstance(num_classes, Column) else F.lit(num_classes)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == label_id).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def sq_dist(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rotate_left(arr: Column, k: Column) -> Column:
    d = F.size(arr)
    return F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.element_at(arr, ((i + k) % d) + 1))
