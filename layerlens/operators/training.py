"""Fitting probe heads and span poolers by data-parallel gradient descent
(M4, M6, A8, M9).

One step is one Spark job: every task reads its share of a mini-batch, takes
the gradients of *all* models at once (numpy matrix products over Arrow
batches, the models along the first axis) and returns one sum of fixed size.
The sums are added up in blocks of parameters, each block by another task, and
only the added gradient (as long as the parameters) reaches the driver, which
makes the optimiser's step and ships the new parameters.

Models that are fitted together have one shape and differ in the rows that
they see (``perm < limit`` in a ``grp``: portions of online coding, layers of
a sweep), in their penalty, rate and first values. Neither the number of jobs
nor the number of scans grows with the number of models.

Examples are rows ``key, grp, perm, label, x1[, x2]``: ``x1`` and ``x2`` are
lists of token vectors, of one span each. Without a pooler a span has one
vector, which goes to the head as it is. With a pooler a span's tokens are
projected, scored and summed by the softmax of their scores; an empty span
pools to the zero vector.

Heads: ``linear``; ``tenney``: Linear, Tanh, LayerNorm, Dropout, Linear;
``hewitt``: Linear, ReLU, Dropout, Linear, ReLU, Dropout, Linear. The loss is
the mean cross-entropy, plus half the penalty times the squared weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYER_NORM_EPS = 1e-5
BLOCK = 1 << 16  # parameters added up by one task
MAX_PARAMETER_BYTES = 512 << 20  # of all models that are fitted together
SLICE_VALUES = 1 << 21  # doubles of one activation array in a task


# ------------------------------------------------------------------- the models


@dataclass(frozen=True)
class Shape:
    """Sizes that all models of a fit share. ``pool`` is the size of a pooled
    span (0: no pooler); ``slots`` is 2 for pairs of spans."""

    input_dim: int
    num_classes: int
    head: str = "tenney"
    hidden: int = 256
    pool: int = 0
    slots: int = 1
    dropout: float = 0.0

    def layout(self) -> dict[str, tuple[int, ...]]:
        d, h, c = self.slots * (self.pool or self.input_dim), self.hidden, self.num_classes
        out: dict[str, tuple[int, ...]] = {}
        if self.pool:
            out |= {"wp": (self.slots, self.pool, self.input_dim), "bp": (self.slots, self.pool), "vp": (self.slots, self.pool)}
        if self.head == "linear":
            return out | {"w2": (c, d), "b2": (c,)}
        out |= {"w1": (h, d), "b1": (h,)}
        if self.head == "tenney":
            out |= {"gamma": (h,), "beta": (h,)}
        elif self.head == "hewitt":
            out |= {"wh": (h, h), "bh": (h,)}
        else:
            raise ValueError("head is 'linear', 'tenney' or 'hewitt'")
        return out | {"w2": (c, h), "b2": (c,)}

    def size(self) -> int:
        return sum(math.prod(s) for s in self.layout().values())

    def views(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters of all models (first axis) by name."""
        out, at = {}, 0
        for name, shape in self.layout().items():
            n = math.prod(shape)
            out[name] = theta[:, at : at + n].reshape(len(theta), *shape)
            at += n
        return out

    def flat(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        names = list(self.layout())
        return np.concatenate([np.asarray(parts[n], np.float64).reshape(len(parts[n]), -1) for n in names], axis=1)

    def penalised(self) -> np.ndarray:
        """1 for the weights of matrices and scorers, 0 for offsets and scales."""
        return np.concatenate([np.full(math.prod(s), float(n[0] in "wv")) for n, s in self.layout().items()])

    def first(self, seeds: Sequence[int]) -> np.ndarray:
        """First values, uniform within one over the root of the inputs."""
        rows = []
        for seed in seeds:
            rng = np.random.default_rng(seed)
            parts = []
            for name, shape in self.layout().items():
                wide = self.layout().get("w" + name[1:], shape)[-1] if name[0] == "b" and name != "beta" else shape[-1]
                value = rng.uniform(-1, 1, shape) / math.sqrt(wide)
                parts.append({"gamma": np.ones(shape), "beta": np.zeros(shape)}.get(name, value).reshape(-1))
            rows.append(np.concatenate(parts))
        return np.array(rows)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def kept_units(key: np.ndarray, units: int, step: int, layer: int, rate: float) -> np.ndarray | None:
    """Scaled dropout mask ``(rows, units)``, a function of the row's key and
    the epoch: a task that is run again drops the same units."""
    if not rate:
        return None
    salt = np.uint64((step * 2 + layer + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = _mix(_mix(key.astype(np.uint64)[:, None] + salt) + np.arange(units, dtype=np.uint64)[None, :])
    return ((x >> np.uint64(11)).astype(np.float64) / float(1 << 53) >= rate) / (1 - rate)


@dataclass
class Rows:
    """A slice of examples: per slot the token vectors of all spans, and the
    number of tokens of each span."""

    label: np.ndarray
    tokens: list[np.ndarray]
    count: list[np.ndarray]
    key: np.ndarray


def _sum_spans(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums over the tokens (second axis) of each span, 0 for empty ones."""
    out = np.zeros((len(values), len(count), *values.shape[2:]))
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        out[:, some] = np.add.reduceat(values, first, axis=1)
    return out


def _pool(w: dict, rows: Rows, slot: int):
    t, count = rows.tokens[slot], rows.count[slot]
    e = np.matmul(t[None], w["wp"][:, slot].transpose(0, 2, 1)) + w["bp"][:, slot, None, :]
    s = np.matmul(e, w["vp"][:, slot, :, None])[..., 0]
    some = np.flatnonzero(count)
    top = np.zeros((len(s), len(count)))
    if len(some):
        top[:, some] = np.maximum.reduceat(s, (np.cumsum(count) - count)[some], axis=1)
    of = np.repeat(np.arange(len(count)), count)
    a = np.exp(s - top[:, of])
    a /= _sum_spans(a, count)[:, of]
    return _sum_spans(a[..., None] * e, count), (e, a, of)


def _unpool(w: dict, rows: Rows, slot: int, kept, d: np.ndarray, grad: dict) -> None:
    e, a, of = kept
    d = d[:, of]
    da = (e * d).sum(axis=2)
    ds = a * (da - _sum_spans(a * da, rows.count[slot])[:, of])
    de = a[..., None] * d + ds[..., None] * w["vp"][:, slot, None, :]
    grad["vp"][:, slot] = np.matmul(ds[:, None, :], e)[:, 0]
    grad["wp"][:, slot] = np.matmul(de.transpose(0, 2, 1), rows.tokens[slot][None])
    grad["bp"][:, slot] = de.sum(axis=1)


def forward(shape: Shape, theta: np.ndarray, rows: Rows, epoch: int | None = None):
    """Logits ``(models, rows, classes)`` and what ``backward`` needs. Units
    are dropped only if an epoch is given."""
    w = shape.views(theta)
    held = {}
    if shape.pool:
        pooled = [_pool(w, rows, k) for k in range(shape.slots)]
        held["pool"] = [p[1] for p in pooled]
        x = np.concatenate([p[0] for p in pooled], axis=2)
    else:
        x = np.concatenate(rows.tokens, axis=1)[None]
    rate = shape.dropout if epoch is not None else 0.0
    mask = [kept_units(rows.key, shape.hidden, epoch or 0, i, rate) for i in (0, 1)]
    line = lambda x, m, b: np.matmul(x, w[m].transpose(0, 2, 1)) + w[b][:, None, :]
    held["x"], held["mask"] = x, mask
    y = x
    if shape.head == "tenney":
        h = np.tanh(line(x, "w1", "b1"))
        sd = np.sqrt(h.var(axis=2, keepdims=True) + LAYER_NORM_EPS)
        n = (h - h.mean(axis=2, keepdims=True)) / sd
        y = n * w["gamma"][:, None, :] + w["beta"][:, None, :]
        y = y if mask[0] is None else y * mask[0]
        held |= {"h": h, "sd": sd, "n": n}
    elif shape.head == "hewitt":
        h = np.maximum(line(x, "w1", "b1"), 0.0)
        h = h if mask[0] is None else h * mask[0]
        y = np.maximum(line(h, "wh", "bh"), 0.0)
        y = y if mask[1] is None else y * mask[1]
        held |= {"h": h}
    held["y"] = y
    return line(y, "w2", "b2"), held


def cross_entropies(z: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each model and row, and its gradient by the logits."""
    top = z.max(axis=2, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=2, keepdims=True)
    at = np.broadcast_to(label[None, :, None], (*z.shape[:2], 1))
    loss = (np.log(total) + top - np.take_along_axis(z, at, axis=2))[..., 0]
    d = e / total
    np.put_along_axis(d, at, np.take_along_axis(d, at, axis=2) - 1.0, axis=2)
    return loss, d


def backward(shape: Shape, theta: np.ndarray, rows: Rows, held: dict, d: np.ndarray) -> np.ndarray:
    """Gradient of all models, one row each, summed over the rows; ``d`` is
    the gradient by the logits, 0 where a model does not see a row."""
    w = shape.views(theta)
    grad = {n: np.zeros((len(theta), *s)) for n, s in shape.layout().items()}

    def unline(m: str, b: str, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        grad[m] = np.matmul(d.transpose(0, 2, 1), x)
        grad[b] = d.sum(axis=1)
        return np.matmul(d, w[m])

    x, mask = held["x"], held["mask"]
    d = unline("w2", "b2", held["y"], d)
    if shape.head == "tenney":
        d = d if mask[0] is None else d * mask[0]
        n = held["n"]
        grad["gamma"], grad["beta"] = (d * n).sum(axis=1), d.sum(axis=1)
        d = d * w["gamma"][:, None, :]
        d = (d - d.mean(axis=2, keepdims=True) - n * (d * n).mean(axis=2, keepdims=True)) / held["sd"]
        d = unline("w1", "b1", x, d * (1.0 - held["h"] ** 2))
    elif shape.head == "hewitt":
        d = d * (held["y"] > 0) if mask[1] is None else d * mask[1] * (held["y"] > 0)
        d = unline("wh", "bh", held["h"], d)
        d = d * (held["h"] > 0) if mask[0] is None else d * mask[0] * (held["h"] > 0)
        d = unline("w1", "b1", x, d)
    if shape.pool:
        for k in range(shape.slots):
            part = d[:, :, k * shape.pool : (k + 1) * shape.pool]
            _unpool(w, rows, k, held["pool"][k], part, grad)
    return shape.flat(grad)


# --------------------------------------------------------------------- the plan


@dataclass(frozen=True)
class Model:
    """The rows of one model (``perm < limit`` in ``grp``) and its settings."""

    limit: int = np.iinfo(np.int64).max
    grp: int = 0
    penalty: float = 0.0
    rate: float = 1e-4
    seed: int = 42


@dataclass
class Plan:
    """How a fit goes: ``batches`` steps an epoch; ``optimizer`` is ``adam`` or
    ``sgd``; ``clip`` bounds the gradient's norm; with validation rows, a model
    stops after ``patience`` epochs without a better loss and keeps its best
    values, and its rate falls by ``plateau`` after every such epoch beyond
    ``plateau_patience``."""

    epochs: int = 50
    batches: int = 1
    optimizer: str = "adam"
    clip: float | None = 5.0
    patience: int = 10
    plateau: float = 0.5
    plateau_patience: int = 0
    seed: int = 42


@dataclass
class State:
    """All that a fit needs to go on after an epoch."""

    epoch: int
    theta: np.ndarray
    best: np.ndarray
    low: np.ndarray  # best validation loss of each model
    bad: np.ndarray  # epochs since then
    rate: np.ndarray
    moment: np.ndarray
    square: np.ndarray
    steps: np.ndarray
    history: list = field(default_factory=list)

    _ARRAYS = ("theta", "best", "low", "bad", "rate", "moment", "square", "steps")

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.epoch, *[np.ascontiguousarray(getattr(self, a), np.float64).tobytes() for a in self._ARRAYS],
                [[float(x) for x in h] for h in self.history])]
        schema = "epoch int, " + ", ".join(f"{a} binary" for a in self._ARRAYS) + ", history array<array<double>>"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={self.epoch:05d}")

    @staticmethod
    def load(spark: SparkSession, path: str, models: int) -> State | None:
        """The last epoch that was saved whole."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        kept = [f.getPath() for f in fs.listStatus(at)]
        done = sorted(str(p) for p in kept if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        if not done:
            return None
        r = spark.read.parquet(done[-1]).first()
        value = {a: np.frombuffer(r[a], np.float64).copy() for a in State._ARRAYS}
        for a in ("theta", "best", "moment", "square"):
            value[a] = value[a].reshape(models, -1)
        return State(r["epoch"], **value, history=[list(h) for h in r["history"]])


# ---------------------------------------------------------------------- the job


def example_rows(df: DataFrame, vectors: Sequence[str], key: str = "id", label: str = "label", perm: str | None = None,
                 grp: str | None = None) -> DataFrame:
    """Examples of whole vectors (one a slot, no pooler)."""
    return df.select(
        F.xxhash64(key).alias("key"), (F.col(grp) if grp else F.lit(0)).cast("int").alias("grp"),
        (F.col(perm) if perm else F.lit(0)).cast("long").alias("perm"), F.col(label).cast("int").alias("label"),
        *[F.array(F.col(v).cast("array<double>")).alias(f"x{k + 1}") for k, v in enumerate(vectors)],
    )


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Vectors of all spans of a batch, tokens of each span, vector size."""
    count = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, count, len(flat) // len(inner) if len(inner) else 0


def _slices(batch: pa.RecordBatch, shape: Shape, models: int):
    """Examples of a batch in slices whose activations stay bounded."""
    names = batch.schema.names
    slots = []
    for k in range(shape.slots):
        flat, count, _ = _tokens(batch.column(names.index(f"x{k + 1}")))
        slots.append((flat.reshape(-1, shape.input_dim), count, np.cumsum(count)))
    label, perm, grp, key = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("label", "perm", "grp", "key"))
    work = sum(c for _, c, _ in slots) if shape.pool else np.full(len(label), 1)
    cost = np.cumsum(np.maximum(work, 1)) * models * max(shape.hidden, shape.pool, shape.num_classes, 1)
    lo = 0
    while lo < len(label):
        base = cost[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cost, base + SLICE_VALUES, side="right")))
        cut = [(t[e[lo] - c[lo] : e[hi - 1]], c[lo:hi]) for t, c, e in slots]
        rows = Rows(label[lo:hi], [t for t, _ in cut], [c for _, c in cut], key[lo:hi].view(np.uint64))
        yield rows, perm[lo:hi], grp[lo:hi]
        lo = hi


def _seen(perm: np.ndarray, grp: np.ndarray, models: Sequence[Model]) -> np.ndarray:
    limit, of = np.array([m.limit for m in models]), np.array([m.grp for m in models])
    return (perm[None, :] < limit[:, None]) & (grp[None, :] == of[:, None])


def _added(spark: SparkSession, rows: DataFrame, each, models: int, width: int) -> np.ndarray:
    """Sums over all rows of what ``each(batch)`` returns, ``(models,
    width)``: one sum a task, then one task a block, in the order of tasks."""
    from pyspark import TaskContext

    def run(batches):
        total = np.zeros((models, width))
        for batch in batches:
            if batch.num_rows:
                each(batch, total)
        flat = total.reshape(-1)
        at = range(0, len(flat), BLOCK)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(at), pa.int32()), pa.array(list(range(len(at))), pa.int32()),
             pa.array([flat[i : i + BLOCK].tobytes() for i in at], pa.binary())],
            names=["part", "block", "sums"],
        )

    def add(table):
        order = np.argsort(table.column("part").to_numpy(), kind="stable").tolist()
        sums = table.column("sums")
        total = np.frombuffer(sums[order[0]].as_py(), np.float64).copy()
        for i in order[1:]:
            total += np.frombuffer(sums[i].as_py(), np.float64)
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "part int, block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
    out = np.zeros(models * width)
    for r in got.collect():  # as many blocks as the parameters have
        value = np.frombuffer(r["sums"], np.float64)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(value)] = value
    return out.reshape(models, width)


def gradients(examples: DataFrame, shape: Shape, models: Sequence[Model], theta: np.ndarray, epoch: int | None = None):
    """Over all rows: the summed gradient, the summed loss and the number of
    rows of each model, from one scan."""
    spark = examples.sparkSession
    models = list(models)
    shared = spark.sparkContext.broadcast(theta)

    def each(batch, total):
        for rows, perm, grp in _slices(batch, shape, len(models)):
            seen = _seen(perm, grp, models)
            use = np.flatnonzero(seen.any(axis=1))  # models that see none of these rows rest
            if not len(use):
                continue
            own, seen = shared.value[use], seen[use]
            z, held = forward(shape, own, rows, epoch)
            loss, d = cross_entropies(z, rows.label)
            total[use, :-2] += backward(shape, own, rows, held, d * seen[..., None])
            total[use, -2] += (loss * seen).sum(axis=1)
            total[use, -1] += seen.sum(axis=1)

    out = _added(spark, examples, each, len(models), shape.size() + 2)
    shared.unpersist()
    return out[:, :-2], out[:, -2], out[:, -1]


def losses(examples: DataFrame, shape: Shape, models: Sequence[Model], theta: np.ndarray, within=None):
    """Summed loss, right answers and rows of each model over the rows that
    ``within(perm, grp)`` names (all rows of its group by default)."""
    spark = examples.sparkSession
    models = list(models)
    shared = spark.sparkContext.broadcast(theta)
    of = np.array([m.grp for m in models])
    within = within or (lambda perm, grp: grp[None, :] == of[:, None])

    def each(batch, total):
        for rows, perm, grp in _slices(batch, shape, len(models)):
            seen = within(perm, grp)
            use = np.flatnonzero(seen.any(axis=1))
            if len(use):
                z, _ = forward(shape, shared.value[use], rows)
                loss, _ = cross_entropies(z, rows.label)
                total[use, 0] += (loss * seen[use]).sum(axis=1)
                total[use, 1] += ((z.argmax(axis=2) == rows.label) & seen[use]).sum(axis=1)
                total[use, 2] += seen[use].sum(axis=1)

    out = _added(spark, examples, each, len(models), 3)
    shared.unpersist()
    return out[:, 0], out[:, 1], out[:, 2]


def step(plan: Plan, shape: Shape, models: Sequence[Model], s: State, grad: np.ndarray, rows: np.ndarray, live: np.ndarray) -> None:
    """One step of the optimiser for all models that saw rows."""
    go = live & (rows > 0)
    penalty = np.array([m.penalty for m in models])[go, None]
    g = grad[go] / rows[go, None] + penalty * shape.penalised()[None, :] * s.theta[go]
    if plan.clip:
        norm = np.sqrt((g**2).sum(axis=1, keepdims=True))
        g = g * np.minimum(1.0, plan.clip / (norm + 1e-6))
    s.steps[go] += 1
    rate = s.rate[go, None]
    if plan.optimizer == "sgd":
        s.theta[go] -= rate * g
        return
    if plan.optimizer != "adam":
        raise ValueError("optimizer is 'adam' or 'sgd'")
    s.moment[go] = 0.9 * s.moment[go] + 0.1 * g
    s.square[go] = 0.999 * s.square[go] + 0.001 * g**2
    t = s.steps[go, None]
    up, down = s.moment[go] / (1 - 0.9**t), s.square[go] / (1 - 0.999**t)
    s.theta[go] -= rate * up / (np.sqrt(down) + 1e-8)


def judge_epoch(plan: Plan, s: State, loss: np.ndarray, live: np.ndarray) -> None:
    """Best values, epochs without a better loss, and rates after an epoch."""
    better = live & (loss < s.low)
    # a rate falls unless the loss is lower by a small share
    clear = loss < np.where(np.isfinite(s.low), s.low * (1 - 1e-4), np.inf)
    s.best[better], s.low[better] = s.theta[better], loss[better]
    s.bad = np.where(better, 0, s.bad + live)
    falls = live & ~clear & (s.bad > plan.plateau_patience)
    s.rate[falls] *= plan.plateau


@dataclass
class Fitted:
    shape: Shape
    models: list[Model]
    theta: np.ndarray
    history: list  # per epoch: mean training loss of each model, then validation


def fit(examples: DataFrame, shape: Shape, models: Sequence[Model], plan: Plan, path: str, validation: DataFrame | None = None,
        first: np.ndarray | None = None) -> Fitted:
    """Fit all ``models`` together. ``path`` is a shared folder: the examples
    are written there once, in one folder a mini-batch, and the state after
    every epoch; a fit that is started again with a path goes on after the
    last whole epoch. Jobs: ``batches`` an epoch, one more with validation,
    whatever the number of models."""
    spark, models = examples.sparkSession, list(models)
    if len(models) * shape.size() * 8 > MAX_PARAMETER_BYTES:
        raise ValueError("too many parameters to fit together: fit fewer models at a time")
    theta = shape.first([m.seed for m in models]) if first is None else np.array(first, np.float64)
    s = State.load(spark, f"{path}/state", len(models))
    if s is None:
        batch = F.pmod(F.xxhash64("key", F.lit(plan.seed)), F.lit(plan.batches)).cast("int")
        examples.withColumn("batch", batch).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/examples")
        if validation is not None:
            validation.write.mode("overwrite").parquet(f"{path}/validation")
        k = len(models)
        s = State(0, theta, theta.copy(), np.full(k, np.inf), np.zeros(k), np.array([m.rate for m in models]),
                  np.zeros_like(theta), np.zeros_like(theta), np.zeros(k))
        s.save(spark, f"{path}/state")
    schema = T.StructType([*examples.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/examples")
    held_out = spark.read.parquet(f"{path}/validation") if validation is not None else None
    while s.epoch < plan.epochs:
        live = s.bad < plan.patience if held_out is not None else np.ones(len(models), bool)
        if not live.any():
            break
        here = np.flatnonzero(live)
        total, seen = np.zeros(len(models)), np.zeros(len(models))
        for b in np.random.default_rng((plan.seed, s.epoch)).permutation(plan.batches).tolist():
            part = rows.where(F.col("batch") == b)
            grad, loss, n = gradients(part, shape, [models[i] for i in here], s.theta[here], s.epoch)
            whole, count = np.zeros_like(s.theta), np.zeros(len(models))
            whole[here], count[here] = grad, n
            total[here] += loss
            seen[here] += n
            step(plan, shape, models, s, whole, count, live)
        record = total / np.maximum(seen, 1)
        if held_out is not None:
            loss, n = np.full(len(models), np.inf), np.zeros(len(models))
            loss[here], _, n[here] = losses(held_out, shape, [models[i] for i in here], s.theta[here])
            loss = loss / np.maximum(n, 1)
            judge_epoch(plan, s, loss, live)
            record = np.concatenate((record, loss))
        s.epoch += 1
        s.history.append(record.tolist())
        s.save(spark, f"{path}/state")
    return Fitted(shape, models, s.best if held_out is not None else s.theta, s.history)


def predict(examples: DataFrame, fitted: Fitted, model: int = 0, keep: Sequence[str] = ("key", "label")) -> DataFrame:
    """``keep…, logits`` of every example under one of the fitted models."""
    shape, theta = fitted.shape, examples.sparkSession.sparkContext.broadcast(fitted.theta[model : model + 1])
    keep = sorted(keep, key=examples.columns.index)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields if f.name in keep)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.concatenate([forward(shape, theta.value, rows)[0][0] for rows, _, _ in _slices(batch, shape, 1)])
            ends = pa.array(np.arange(len(z) + 1) * shape.num_classes, pa.int32())
            logits = pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))
            held = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, logits], names=[*keep, "logits"])

    return examples.mapInArrow(run, f"{kinds}, logits array<double>")


def span_examples(tokens: DataFrame, targets: DataFrame, spans: Sequence[tuple[str, str]], key: Sequence[str], label: str = "label",
                  seq: str = "seq") -> DataFrame:
    """Examples of token spans (J5): ``tokens`` are ``seq, pos, vector``,
    ``targets`` have ``key…, seq, label`` and for each slot the columns of a
    span's bounds ``a <= pos < b``. A target's tokens are as many as its
    sequence has at most; an empty span has an empty list."""
    key = list(key)
    out = targets.select(*key, F.col(label).cast("int").alias("label"))
    for k, (a, b) in enumerate(spans):
        t = tokens.select(F.col(seq).alias("_seq"), "pos", F.col("vector").cast("array<double>").alias("vector"))
        on = (F.col(seq) == F.col("_seq")) & (F.col("pos") >= F.col(a)) & (F.col("pos") < F.col(b))
        held = targets.select(*{*key, seq, a, b}).join(t, on).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("_l"))
        held = held.select(*key, F.transform("_l", lambda e: e["vector"]).alias(f"x{k + 1}"))
        out = out.join(held, key, "left").withColumn(f"x{k + 1}", F.coalesce(f"x{k + 1}", F.array().cast("array<array<double>>")))
    return out.select(
        F.xxhash64(*key).alias("key"), F.lit(0).alias("grp"), F.lit(0).cast("long").alias("perm"), "label",
        *[f"x{k + 1}" for k in range(len(spans))], *key,
    )


def from_parts(shape: Shape, parts: dict, models: int = 1) -> np.ndarray:
    """First parameters of all models from one set of arrays by name."""
    one = shape.flat({n: np.asarray(parts[n], np.float64)[None] for n in shape.layout()})
    return np.repeat(one, models, axis=0)
