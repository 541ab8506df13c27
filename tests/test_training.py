"""Fitted probes and poolers: gradients against finite differences, the
distributed fit against one in this process, many models at once against each
alone, early stop, and going on after a lost driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.operators import codelength as L
from layerlens.operators import training as T

RNG = np.random.default_rng(0)


def random_rows(n=7, dim=5, classes=4, slots=1, pool=True, rng=RNG):
    count = [rng.integers(0, 5, n) if pool else np.ones(n, np.int64) for _ in range(slots)]
    tokens = [rng.normal(size=(int(c.sum()), dim)) for c in count]
    return T.Rows(rng.integers(0, classes, n), tokens, count, rng.integers(0, 2**62, n).astype(np.uint64))


@pytest.mark.parametrize("head", ["linear", "tenney", "hewitt"])
@pytest.mark.parametrize("pool, slots", [(0, 1), (0, 2), (3, 1), (3, 2)])
def test_gradients_equal_finite_differences(head, pool, slots):
    shape = T.Shape(5, 4, head, 6, pool, slots, 0.3)
    theta = shape.first([1, 2]) + 0.1 * RNG.normal(size=(2, shape.size()))
    rows = random_rows(slots=slots, pool=bool(pool))
    seen = RNG.random((2, 7)) < 0.7

    def loss(t):
        z, held = T.forward(shape, t, rows, 3)
        each, d = T.cross_entropies(z, rows.label)
        return (each * seen).sum(axis=1), held, d

    _, held, d = loss(theta)
    grad = T.backward(shape, theta, rows, held, d * seen[..., None])
    for j in range(shape.size()):
        e = np.zeros_like(theta)
        e[:, j] = 1e-6
        slope = (loss(theta + e)[0] - loss(theta - e)[0]) / 2e-6
        assert np.abs(slope - grad[:, j]).max() < 1e-8 * max(1.0, np.abs(grad).max()) + 2e-8


def frame(spark, n, dim, classes, seed=1, tokens=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, dim))
    rows = []
    for i in range(n):
        y = int(rng.integers(0, classes))
        x = [(centre[y] + rng.normal(size=dim)).tolist() for _ in range(int(rng.integers(0, tokens)) if tokens else 1)]
        rows.append((i, i % 2, i, y, x))
    return rows, spark.createDataFrame(rows, "key long, grp int, perm long, label int, x1 array<array<double>>").repartition(5)


def own_fit(rows, shape, model, plan, theta, batch_of):
    """The same fit in this process, without any of the job's code for steps:
    the optimiser's rule is written out."""
    mine = [r for r in rows if r[1] == model.grp and r[2] < model.limit]
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    history = []
    for epoch in range(plan.epochs):
        total = 0.0
        for b in np.random.default_rng((plan.seed, epoch)).permutation(plan.batches):
            part = [r for r in mine if batch_of[r[0]] == b]
            if not part:
                continue
            count = np.array([len(r[4]) for r in part])
            x = np.array([u for r in part for u in r[4]]).reshape(-1, shape.input_dim)
            data = T.Rows(np.array([r[3] for r in part]), [x], [count], np.array([r[0] for r in part], np.uint64))
            z, held = T.forward(shape, theta, data, epoch)
            loss, d = T.cross_entropies(z, data.label)
            total += loss.sum()
            g = T.backward(shape, theta, data, held, d) / len(part) + model.penalty * shape.penalised() * theta
            if plan.clip:
                g *= min(1.0, plan.clip / (np.sqrt((g**2).sum()) + 1e-6))
            if plan.optimizer == "sgd":
                theta = theta - model.rate * g
            else:
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                theta = theta - model.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        history.append(total / len(mine))
    return theta, history


@pytest.mark.parametrize("head, pool, optimizer, dropout", [("tenney", 0, "adam", 0.2), ("hewitt", 4, "sgd", 0.0)])
def test_models_fitted_together_equal_each_alone(spark, tmp_path, head, pool, optimizer, dropout):
    rows, df = frame(spark, 90, 6, 3, tokens=4 if pool else 0)
    shape = T.Shape(6, 3, head, 5, pool, 1, dropout)
    plan = T.Plan(epochs=2, batches=3, optimizer=optimizer, clip=0.5)
    models = [T.Model(limit, grp, penalty, 0.05, 7) for limit in (11, 40, 200) for grp, penalty in ((0, 0.0), (1, 0.1))]
    fitted = T.fit(df, shape, models, plan, str(tmp_path / "fit"))
    batch_of = {r["key"]: r["b"] for r in df.select("key", F.pmod(F.xxhash64("key", F.lit(plan.seed)), F.lit(3)).alias("b")).collect()}
    for i, model in enumerate(models):
        theta, history = own_fit(rows, shape, model, plan, shape.first([7]), batch_of)
        assert np.abs(theta[0] - fitted.theta[i]).max() < 1e-8
        assert [h[i] for h in fitted.history] == pytest.approx(history, abs=1e-8)


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_jobs_do_not_grow_with_the_models(spark, tmp_path):
    _, df = frame(spark, 40, 4, 2)
    shape, plan = T.Shape(4, 2, "linear", 0), T.Plan(epochs=2, batches=2)
    n = [jobs_of(spark, f"fit-{k}", lambda k=k: T.fit(df, shape, [T.Model(10 + i) for i in range(k)], plan, str(tmp_path / str(k)))) for k in (1, 9)]
    assert n[0] == n[1]


def test_early_stop_keeps_the_best_values(spark, tmp_path):
    _, train = frame(spark, 60, 6, 3, seed=3)
    _, other = frame(spark, 60, 6, 3, seed=4)  # other centres: more fit, worse loss
    shape, plan = T.Shape(6, 3, "tenney", 8), T.Plan(epochs=12, patience=2, plateau=0.5)
    models = [T.Model(rate=0.05), T.Model(rate=0.2)]
    fitted = T.fit(train.withColumn("grp", F.lit(0)), shape, models, plan, str(tmp_path / "f"), other.withColumn("grp", F.lit(0)))
    loss = np.array([h[2:] for h in fitted.history])
    assert len(fitted.history) < 12
    sums, _, n = T.losses(other.withColumn("grp", F.lit(0)), shape, models, fitted.theta)
    assert sums / n == pytest.approx(loss.min(axis=0), abs=1e-10)


def test_a_fit_goes_on_after_the_last_epoch(spark, tmp_path):
    _, df = frame(spark, 50, 4, 3)
    shape, models = T.Shape(4, 3, "tenney", 4, dropout=0.1), [T.Model(rate=0.1), T.Model(20, rate=0.1)]
    whole = T.fit(df, shape, models, T.Plan(epochs=4, batches=2), str(tmp_path / "a"))
    T.fit(df, shape, models, T.Plan(epochs=2, batches=2), str(tmp_path / "b"))
    rest = T.fit(df, shape, models, T.Plan(epochs=4, batches=2), str(tmp_path / "b"))
    assert np.abs(whole.theta - rest.theta).max() < 1e-12 and len(rest.history) == 4


def test_gradient_blocks_and_empty_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "SLICE_VALUES", 30)
    _, df = frame(spark, 30, 4, 3, tokens=3)
    shape = T.Shape(4, 3, "tenney", 4, 2)
    theta = shape.first([1, 2])
    models = [T.Model(grp=0), T.Model(grp=5)]  # nobody is in group 5
    grad, loss, n = T.gradients(df.repartition(40), shape, models, theta)
    again, _, _ = T.gradients(df.coalesce(1), shape, models, theta)
    assert np.abs(grad - again).max() < 1e-10
    assert n.tolist() == [15, 0] and loss[1] == 0 and not grad[1].any()


def test_trained_coding_portions(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(3)[i % 3] * 3 + rng.normal(size=3)).tolist(), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    shape, plan = T.Shape(3, 3, "hewitt", 8), T.Plan(epochs=30, clip=None)
    per = L.online_coding_fitted(df, shape, plan, str(tmp_path / "c"), (0.001, 0.25, 0.5, 1.0), [T.Model(rate=0.05)]).orderBy("portion_idx").collect()
    assert [r["n_fit"] for r in per] == [0, 30, 60] and [r["n_scored"] for r in per] == [30, 30, 60]
    assert per[0]["ce_sum"] == pytest.approx(30 * np.log(3))  # an empty portion: the uniform code
    assert per[0]["compression"] > 1.0


def test_too_many_parameters_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MAX_PARAMETER_BYTES", 100)
    _, df = frame(spark, 4, 4, 2)
    with pytest.raises(ValueError):
        T.fit(df, T.Shape(4, 2, "linear", 0), [T.Model()] * 9, T.Plan(epochs=1), str(tmp_path / "x"))
