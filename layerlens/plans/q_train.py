"""Registered queries that fit probes and poolers (M4, M6, M10, A8, M9), with
SQL that repeats every step of the fit: plain gradient descent over all rows
from stored first parameters. Adam, mini-batches, dropout and early stop run
through the same code and are tested against a fit in one process."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from layerlens.operators import classification as C
from layerlens.operators import codelength as L
from layerlens.operators import probes as P
from layerlens.operators import sampling as S
from layerlens.operators import training as T
from layerlens.operators.inference import one_row
from layerlens.plans.fixtures import f3_vectors, f5_hidden_states, rotate_left
from layerlens.plans.q_dataset import _PERM, F3_PORTIONS
from layerlens.plans.registry import register
from layerlens.sources.tables import table
from layerlens.streaming.metric_streams import scratch

NUM_CLASSES, HIDDEN, DIM = 10, 8, 64
RATE, EPOCHS, PENALTIES = 0.5, 3, (0.0, 0.05)
_TENNEY = T.Shape(DIM, NUM_CLASSES, "tenney", HIDDEN)


def _plan(epochs: int = EPOCHS) -> T.Plan:
    return T.Plan(epochs=epochs, optimizer="sgd", clip=None)


def _rule_parameters(spark, shape: T.Shape, models: int = 1) -> np.ndarray:
    return T.from_parts(shape, one_row(P.params_from_rule(spark, shape.input_dim, HIDDEN, NUM_CLASSES, shape.head)), models)


# ------------------------------------------------------------- the steps in SQL


def _list(n: int, body: str) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: {body})"


_FIRST = (
    f"SELECT g, {_list(HIDDEN, f'list_transform(range(0, {DIM}), lambda d: ((((i - 1) * 7 + d * 3) % 11) - 5) / 10.0::DOUBLE)')} AS w1, "
    f"{_list(HIDDEN, '((((i - 1) * 5) % 7) - 3) / 10.0::DOUBLE')} AS b1, {_list(HIDDEN, '1.0::DOUBLE + (i - 1) / 10.0::DOUBLE')} AS gm, "
    f"{_list(HIDDEN, '((((i - 1) * 5 + 1) % 7) - 3) / 10.0::DOUBLE')} AS be, "
    f"{_list(NUM_CLASSES, f'list_transform(range(0, {HIDDEN}), lambda d: ((((i - 1) * 7 + d * 3 + 1) % 11) - 5) / 10.0::DOUBLE)')} AS w2, "
    f"{_list(NUM_CLASSES, '((((i - 1) * 5 + 2) % 7) - 3) / 10.0::DOUBLE')} AS b2"
)
_WIDTHS = {"b1": HIDDEN, "gm": HIDDEN, "be": HIDDEN, "b2": NUM_CLASSES}


def _forward(rows: str, params: str, x: str) -> str:
    """CTEs from ``rows(g, id, v, label)`` to ``{x}z`` with logits z, their
    softmax p and the loss ce."""
    mean = lambda c: f"list_sum({c}) / len({c})"
    return f"""
{x}a AS (SELECT r.*, w1, b1, gm, be, w2, b2, {_list(HIDDEN, 'tanh(list_inner_product(w1[i], v) + b1[i])')} AS h FROM {rows} r JOIN {params} USING (g)),
{x}b AS (SELECT *, sqrt({mean('list_transform(h, lambda y: (y - mu) * (y - mu))')} + 1e-5) AS sd FROM (SELECT *, {mean('h')} AS mu FROM {x}a)),
{x}c AS (SELECT *, {_list(HIDDEN, '(h[i] - mu) / sd')} AS n FROM {x}b),
{x}d AS (SELECT *, {_list(HIDDEN, 'n[i] * gm[i] + be[i]')} AS y FROM {x}c),
{x}e AS (SELECT *, {_list(NUM_CLASSES, 'list_inner_product(w2[i], y) + b2[i]')} AS z FROM {x}d),
{x}z AS (SELECT *, list_transform(z, lambda q: exp(q - lse)) AS p, lse - z[label + 1] AS ce
  FROM (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda q: exp(q - list_max(z))))) AS lse FROM {x}e))"""


def _step(x: str, before: str, after: str, models: str, penalty: bool) -> str:
    """CTEs from ``{x}z`` to the parameters after one step."""
    p = f"{x}z"
    summed = lambda name, n, m, a, b: f"""
{x}{name} AS (SELECT g, list(w ORDER BY i) AS s FROM (SELECT g, i, list(s ORDER BY j) AS w FROM (
  SELECT g, i, j, sum({a}[i] * {b}[j]) AS s FROM {x}g CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {m + 1})) AS j)
  GROUP BY g, i, j) GROUP BY g, i) GROUP BY g)"""  # noqa: E731
    lone = lambda name, n, a: f"""
{x}{name} AS (SELECT g, list(s ORDER BY i) AS s FROM (SELECT g, i, sum({a}[i]) AS s FROM {x}g CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS i)
  GROUP BY g, i) GROUP BY g)"""  # noqa: E731
    decay = "+ pen * o.{0}[i][j]" if penalty else ""
    matrix = lambda c, n, m: _list(n, f"list_transform(range(1, {m + 1}), lambda j: o.{c}[i][j] - {RATE}::DOUBLE * (g_{c}.s[i][j] / {x}n.n {decay.format(c)}))")
    vector = lambda c: _list(_WIDTHS[c], f"o.{c}[i] - {RATE}::DOUBLE * g_{c}.s[i] / {x}n.n")
    names = ["w1", "b1", "gm", "be", "w2", "b2"]
    return f"""
{x}f AS (SELECT *, {_list(NUM_CLASSES, 'p[i] - CASE WHEN i = label + 1 THEN 1 ELSE 0 END')} AS dz FROM {p}),
{x}k AS (SELECT *, {_list(HIDDEN, 'list_inner_product(dz, list_transform(w2, lambda r: r[i]))')} AS dy FROM {x}f),
{x}l AS (SELECT *, {_list(HIDDEN, 'dy[i] * n[i]')} AS dgm, {_list(HIDDEN, 'dy[i] * gm[i]')} AS dn FROM {x}k),
{x}m AS (SELECT *, list_sum(dn) / {HIDDEN} AS m1, list_inner_product(dn, n) / {HIDDEN} AS m2 FROM {x}l),
{x}g AS (SELECT g, id, v, y, dz, dy, dgm, {_list(HIDDEN, '(dn[i] - m1 - n[i] * m2) / sd * (1 - h[i] * h[i])')} AS da FROM {x}m),
{summed('w1', HIDDEN, DIM, 'da', 'v')}, {lone('b1', HIDDEN, 'da')}, {lone('gm', HIDDEN, 'dgm')}, {lone('be', HIDDEN, 'dy')},
{summed('w2', NUM_CLASSES, HIDDEN, 'dz', 'y')}, {lone('b2', NUM_CLASSES, 'dz')},
{x}n AS (SELECT g, count(*) AS n FROM {x}g GROUP BY g),
{after} AS (SELECT o.g, {matrix('w1', HIDDEN, DIM)} AS w1, {vector('b1')} AS b1, {vector('gm')} AS gm, {vector('be')} AS be,
  {matrix('w2', NUM_CLASSES, HIDDEN)} AS w2, {vector('b2')} AS b2
  FROM {before} o JOIN {models} USING (g) JOIN {x}n USING (g) {' '.join(f'JOIN {x}{c} g_{c} USING (g)' for c in names)})"""


def _fit_sql(rows: str, models: str, epochs: int, penalty: bool = False) -> str:
    """CTEs from ``rows(g, id, v, label)`` and ``models(g[, pen])`` to the
    fitted parameters ``p{epochs}``."""
    parts = [f"p0 AS ({_FIRST} FROM {models})"]
    for t in range(epochs):
        parts += [_forward(rows, f"p{t}", f"s{t}"), _step(f"s{t}", f"p{t}", f"p{t + 1}", models, penalty)]
    return ", ".join(parts)


# ------------------------------------------------------------------- the queries

_SPLIT = f"""
sz AS (SELECT count(*) * 3 // 10 AS n_test FROM embeddings),
sp AS (SELECT 0 AS g, vec_id AS id, embedding::DOUBLE[] AS v, label, CASE WHEN perm < n_test // 2 THEN 'test' WHEN perm < n_test THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {_PERM.format(id='vec_id')} AS perm FROM embeddings), sz)"""


def _whole_split(df, id_col="id"):
    """Every row is of a split: 15 % test, 15 % validation, the rest train."""
    n = df.count()
    return S.exact_split(df, n - n * 3 // 10, n * 3 // 10, id_col, n=n)


@register("probe_train_predict", oracle=f"""
WITH {_SPLIT},
tr AS (SELECT g, id, v, label FROM sp WHERE split = 'train'), md AS (SELECT 0 AS g),
{_fit_sql('tr', 'md', EPOCHS)}, {_forward('sp', f'p{EPOCHS}', 'o')}
SELECT id, split, (list_position(z, list_max(z)) - 1)::INTEGER AS pred, round(ce, 6) AS ce FROM oz
""")
def probe_train_predict(spark, sf_dir):
    """The head Linear, Tanh, LayerNorm, Linear fitted on the train
    split by gradient descent, and every row of every split predicted."""
    sp = _whole_split(f3_vectors(spark, sf_dir))
    examples = T.example_rows(sp.where("split = 'train'"), ["vector"])
    fitted = T.fit(examples, _TENNEY, [T.Model(rate=RATE)], _plan(), scratch(spark, "probe-fit"), first=_rule_parameters(spark, _TENNEY))
    rows = sp.select("id", "split", "label", F.array(F.col("vector").cast("array<double>")).alias("x1"),
                     F.xxhash64("id").alias("key"), F.lit(0).alias("grp"), F.lit(0).cast("long").alias("perm"))
    found = C.with_predictions(T.predict(rows, fitted, keep=("id", "split", "label")))
    return found.select("id", "split", F.col("pred").cast("int").alias("pred"), F.round("ce", 6).alias("ce"))


@register("probe_train_metrics", oracle=f"""
WITH {_SPLIT},
tr AS (SELECT g, id, v, label FROM sp WHERE split = 'train'), md AS (SELECT 0 AS g),
{_fit_sql('tr', 'md', EPOCHS)}, {_forward('sp', f'p{EPOCHS}', 'o')},
sc AS (SELECT split, label, list_position(z, list_max(z)) - 1 AS pred, ce FROM oz),
cls AS (SELECT range AS k FROM range(0, {NUM_CLASSES})),
st AS (SELECT split, k, sum(CASE WHEN label = k AND pred = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label <> k AND pred = k THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = k AND pred <> k THEN 1 ELSE 0 END) AS fn FROM sc CROSS JOIN cls GROUP BY split, k)
SELECT split, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(loss, 6) AS loss, n_rows
FROM (SELECT split, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, avg(ce) AS loss, count(*) AS n_rows FROM sc GROUP BY split)
JOIN (SELECT split, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM st GROUP BY split) USING (split)
""")
def probe_train_metrics(spark, sf_dir):
    """A1–A3 of a fitted probe on every split; the splits hold all rows."""
    sp = _whole_split(f3_vectors(spark, sf_dir))
    examples = T.example_rows(sp.where("split = 'train'"), ["vector"])
    fitted = T.fit(examples, _TENNEY, [T.Model(rate=RATE)], _plan(), scratch(spark, "probe-fit"), first=_rule_parameters(spark, _TENNEY))
    rows = sp.select("split", "label", F.array(F.col("vector").cast("array<double>")).alias("x1"),
                     F.xxhash64("id").alias("key"), F.lit(0).alias("grp"), F.lit(0).cast("long").alias("perm"))
    found = C.with_predictions(T.predict(rows, fitted, keep=("split", "label")))
    # one table of counts a split, true class and predicted class gives all three
    cells = found.groupBy("split", "label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("ce").alias("ce"))
    both = cells.select("split", F.explode(F.array(
        F.struct(F.col("label").alias("k"), F.lit(0).alias("side")), F.struct(F.col("pred").alias("k"), F.lit(1).alias("side"))
    )).alias("e"), "n", (F.col("label") == F.col("pred")).alias("hit"))
    per = both.groupBy("split", "e.k").agg(
        F.sum(F.when(F.col("hit") & (F.col("e.side") == 0), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both")
    )
    f1 = per.groupBy("split").agg(F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"))
    plain = cells.groupBy("split").agg(
        (F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        (F.sum("ce") / F.sum("n")).alias("loss"), F.sum("n").alias("n_rows"),
    )
    return plain.join(f1, "split").select(
        "split", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"),
        F.round("loss", 6).alias("loss"), "n_rows",
    )


_PORTIONS_SQL = """
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(floor((SELECT count(*) FROM embeddings) * fraction) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0)"""


@register("online_coding_gradient", oracle=f"""
WITH {_PORTIONS_SQL},
p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, {_PERM.format(id='vec_id')} AS perm FROM embeddings),
md AS (SELECT portion_idx AS g FROM pt WHERE n_next IS NOT NULL),
mem AS (SELECT portion_idx AS g, p.id, v, label FROM p JOIN pt ON perm < n AND n_next IS NOT NULL),
chk AS (SELECT portion_idx AS g, p.id, v, label FROM p JOIN pt ON perm >= n AND perm < n_next),
{_fit_sql('mem', 'md', EPOCHS)}, {_forward('chk', f'p{EPOCHS}', 'o')},
per AS (SELECT g, sum(ce) AS ce_sum, count(*) AS n_scored FROM oz GROUP BY g),
tot AS (SELECT (SELECT n FROM pt WHERE portion_idx = 0) * log2({NUM_CLASSES}) + (SELECT sum(ce_sum) FROM per) AS mdl)
SELECT pt.portion_idx::INTEGER AS portion_idx, n AS n_fit, round(ce_sum, 5) AS ce_sum, n_scored,
  round((SELECT count(*) FROM p) * log2({NUM_CLASSES}) / mdl, 6) AS compression
FROM per JOIN pt ON g = pt.portion_idx, tot
""")
def online_coding_gradient(spark, sf_dir):
    """A8 with trained probes: the probes of all portions fitted together, one
    job a step; the code length of each next chunk, and the compression."""
    first = _rule_parameters(spark, _TENNEY, len(F3_PORTIONS) - 1)
    per = L.online_coding_fitted(
        f3_vectors(spark, sf_dir), _TENNEY, _plan(), scratch(spark, "coding-fit"), F3_PORTIONS, [T.Model(rate=RATE)], first=first
    )
    return per.select("portion_idx", "n_fit", F.round("ce_sum", 5).alias("ce_sum"), "n_scored", F.round("compression", 6).alias("compression"))


_LAYERS = (0, 1, 2)


@register("sweep_gradient", oracle=f"""
WITH {_PORTIONS_SQL},
p AS (SELECT vec_id AS id, label, perm, layer,
    list_transform(range(0, {DIM}), lambda i: embedding[i + 1]::DOUBLE + layer / 2::DOUBLE * embedding[((i + layer) % {DIM}) + 1]::DOUBLE) AS v
  FROM (SELECT *, {_PERM.format(id='vec_id')} AS perm FROM embeddings) CROSS JOIN (SELECT unnest([0, 1, 2]) AS layer)),
md AS (SELECT layer * 100 + setting * 10 + portion_idx AS g, layer, setting, pen, portion_idx, n, n_next
  FROM pt CROSS JOIN (SELECT unnest([0, 1, 2]) AS layer) CROSS JOIN (SELECT * FROM (VALUES (0, {PENALTIES[0]}::DOUBLE), (1, {PENALTIES[1]}::DOUBLE)) t(setting, pen))
  WHERE n_next IS NOT NULL),
mem AS (SELECT g, p.id, v, label FROM p JOIN md ON p.layer = md.layer AND perm < n),
chk AS (SELECT g, p.id, v, label FROM p JOIN md ON p.layer = md.layer AND perm >= n AND perm < n_next),
{_fit_sql('mem', 'md', 2, True)}, {_forward('chk', 'p2', 'o')}
SELECT layer::INTEGER AS layer, setting::INTEGER AS setting,
  round((SELECT n FROM pt WHERE portion_idx = 0) * log2({NUM_CLASSES}) + sum(ce), 5) AS mdl, count(*) AS n_scored
FROM oz JOIN md USING (g) GROUP BY layer, setting
""")
def sweep_gradient(spark, sf_dir):
    """M9 with trained probes and a hyper-parameter: three layers, two
    penalties and all portions fitted together, one job a step."""
    wide = f3_vectors(spark, sf_dir).withColumn("vector", F.col("vector").cast("array<double>"))
    rows = wide.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in _LAYERS])))
    turned = rotate_left(F.col("vector"), F.col("layer"))
    rows = rows.withColumn("vector", F.zip_with("vector", turned, lambda x, y: x + F.col("layer").cast("double") / 2 * y))
    settings = [T.Model(rate=RATE, penalty=p) for p in PENALTIES]
    first = _rule_parameters(spark, _TENNEY, len(_LAYERS) * len(settings) * (len(F3_PORTIONS) - 1))
    per = L.online_coding_fitted(rows, _TENNEY, _plan(2), scratch(spark, "sweep-fit"), F3_PORTIONS, settings, ["layer"], first=first)
    return per.groupBy("layer", "setting").agg(F.round(F.first("mdl"), 5).alias("mdl"), F.sum("n_scored").alias("n_scored"))


POOL, SPANS = 4, ((3, 8), (10, 15))
_PAIR = T.Shape(DIM, 2, "linear", 0, POOL, 2)


def _pair_first() -> dict:
    """First parameters from an integer rule."""
    wp = [[[(((r * 7 + d * 3 + k) % 11) - 5) / 10.0 for d in range(DIM)] for r in range(POOL)] for k in (0, 1)]
    bp = [[(((r * 5 + k) % 7) - 3) / 10.0 for r in range(POOL)] for k in (0, 1)]
    vp = [[(((r * 3 + k) % 5) - 2) / 10.0 for r in range(POOL)] for k in (0, 1)]
    w2 = [[(((c * 7 + j * 3) % 11) - 5) / 10.0 for j in range(2 * POOL)] for c in (0, 1)]
    return {"wp": wp, "bp": bp, "vp": vp, "w2": w2, "b2": [0.1, -0.1]}


def _pair_sql(epochs: int) -> str:
    """The pooler and a linear head, both fitted: CTEs ``a0, a1, …`` (pooler
    parameters per slot), ``q0, q1, …`` (head), ``l0, l1, …`` (loss)."""
    out = [
        f"""a0 AS (SELECT k, list_transform(range(0, {POOL}), lambda r: list_transform(range(0, {DIM}), lambda d: (((r * 7 + d * 3 + k) % 11) - 5) / 10.0::DOUBLE)) AS w,
    list_transform(range(0, {POOL}), lambda r: (((r * 5 + k) % 7) - 3) / 10.0::DOUBLE) AS b,
    list_transform(range(0, {POOL}), lambda r: (((r * 3 + k) % 5) - 2) / 10.0::DOUBLE) AS u FROM (SELECT unnest([0, 1]) AS k)),
q0 AS (SELECT list_transform([0, 1], lambda c: list_transform(range(0, {2 * POOL}), lambda j: (((c * 7 + j * 3) % 11) - 5) / 10.0::DOUBLE)) AS w, [0.1::DOUBLE, -0.1::DOUBLE] AS b)"""
    ]
    each = lambda body, n=POOL: f"list_transform(range(1, {n + 1}), lambda i: {body})"
    rate = f"{RATE}::DOUBLE"
    for t in range(epochs):
        x = f"x{t}"
        out.append(f"""
{x}e AS (SELECT tk.*, {each('list_inner_product(w[i], v) + b[i]')} AS e, u FROM tk JOIN a{t} USING (k)),
{x}s AS (SELECT *, list_inner_product(e, u) AS s FROM {x}e),
{x}a AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY seq, k) AS a FROM (SELECT *, max(s) OVER (PARTITION BY seq, k) AS m FROM {x}s)),
{x}p AS (SELECT seq, k, i, sum(a * e[i]) AS p FROM {x}a CROSS JOIN (SELECT unnest(range(1, {POOL + 1})) AS i) GROUP BY seq, k, i),
{x}c AS (SELECT seq, label, list_transform(range(1, {2 * POOL + 1}), lambda j: coalesce(y[j], 0.0::DOUBLE)) AS y FROM tg LEFT JOIN
  (SELECT seq, map_from_entries(list((k * {POOL} + i, p))) AS y FROM {x}p GROUP BY seq) USING (seq)),
{x}z AS (SELECT seq, label, y, z, exp(z[1] - lse) AS p0, exp(z[2] - lse) AS p1, lse - z[label + 1] AS ce, w FROM (
  SELECT *, greatest(z[1], z[2]) + ln(exp(z[1] - greatest(z[1], z[2])) + exp(z[2] - greatest(z[1], z[2]))) AS lse FROM (
    SELECT seq, label, y, w, [list_inner_product(w[1], y) + b[1], list_inner_product(w[2], y) + b[2]] AS z FROM {x}c, q{t}))),
l{t} AS (SELECT avg(ce) AS loss FROM {x}z),
{x}d AS (SELECT seq, y, [p0 - CASE WHEN label = 0 THEN 1 ELSE 0 END, p1 - CASE WHEN label = 1 THEN 1 ELSE 0 END] AS dz, w,
    (SELECT count(*) FROM tg) AS n FROM {x}z),
{x}y AS (SELECT seq, {each('dz[1] * w[1][i] + dz[2] * w[2][i]', 2 * POOL)} AS dy, n FROM {x}d),
{x}h AS (SELECT *, list_inner_product(e, dp) AS da FROM (
  SELECT {x}a.*, n, list_slice(dy, k * {POOL} + 1, k * {POOL} + {POOL}) AS dp FROM {x}a JOIN {x}y USING (seq))),
{x}g AS (SELECT k, v, n, e, ds, {each('a * dp[i] + ds * u[i]')} AS de FROM (
  SELECT *, a * (da - sum(a * da) OVER (PARTITION BY seq, k)) AS ds FROM {x}h)),
{x}w AS (SELECT k, list(r ORDER BY i) AS s FROM (SELECT k, i, list(s ORDER BY j) AS r FROM (
  SELECT k, i, j, sum(de[i] * v[j]) / any_value(n) AS s FROM {x}g CROSS JOIN (SELECT unnest(range(1, {POOL + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {DIM + 1})) AS j)
  GROUP BY k, i, j) GROUP BY k, i) GROUP BY k),
{x}u AS (SELECT k, list(sb ORDER BY i) AS sb, list(su ORDER BY i) AS su FROM (
  SELECT k, i, sum(de[i]) / any_value(n) AS sb, sum(ds * e[i]) / any_value(n) AS su FROM {x}g CROSS JOIN (SELECT unnest(range(1, {POOL + 1})) AS i) GROUP BY k, i) GROUP BY k),
a{t + 1} AS (SELECT k, {each(f'list_transform(range(1, {DIM + 1}), lambda j: o.w[i][j] - {rate} * {x}w.s[i][j])')} AS w,
    {each(f'o.b[i] - {rate} * sb[i]')} AS b, {each(f'o.u[i] - {rate} * su[i]')} AS u FROM a{t} o JOIN {x}w USING (k) JOIN {x}u USING (k)),
{x}q AS (SELECT list(r ORDER BY c) AS s, list(sb ORDER BY c) AS sb FROM (SELECT c, list(s ORDER BY j) AS r, any_value(sb) AS sb FROM (
  SELECT c, j, sum(dz[c] * y[j]) / any_value(n) AS s, sum(dz[c]) / any_value(n) AS sb FROM {x}d CROSS JOIN (SELECT unnest([1, 2]) AS c) CROSS JOIN (SELECT unnest(range(1, {2 * POOL + 1})) AS j)
  GROUP BY c, j) GROUP BY c)),
q{t + 1} AS (SELECT {each(f'list_transform(range(1, {2 * POOL + 1}), lambda j: o.w[i][j] - {rate} * {x}q.s[i][j])', 2)} AS w,
    {each(f'o.b[i] - {rate} * {x}q.sb[i]', 2)} AS b FROM q{t} o, {x}q)""")
    return ", ".join(out)


_PAIR_EPOCHS = 2


@register("pooler_train", oracle=f"""
WITH f5 AS (SELECT vec_id // 20 AS seq, vec_id % 20 AS pos, label, list_transform(range(0, {DIM}), lambda i: embedding[((i + 1) % {DIM}) + 1]::DOUBLE) AS v FROM embeddings),
tg AS (SELECT seq, (sum(label) % 2)::INTEGER AS label FROM f5 GROUP BY seq),
tk AS (SELECT seq, 0 AS k, pos, v FROM f5 WHERE pos >= {SPANS[0][0]} AND pos < {SPANS[0][1]} UNION ALL SELECT seq, 1, pos, v FROM f5 WHERE pos >= {SPANS[1][0]} AND pos < {SPANS[1][1]}),
{_pair_sql(_PAIR_EPOCHS)}
SELECT k::INTEGER AS slot, i::INTEGER AS unit, round(u[i], 6) AS scorer, round(b[i], 6) AS bias, round(list_sum(w[i]), 5) AS weights,
  (SELECT round(loss, 6) FROM l{_PAIR_EPOCHS - 1}) AS loss
FROM a{_PAIR_EPOCHS} CROSS JOIN (SELECT unnest(range(1, {POOL + 1})) AS i)
""")
def pooler_train(spark, sf_dir):
    """M4/M6 for pairs: projections and attention scorers of both span slots
    fitted together with the head on top of them, over layer-1 states; the
    fitted pooler and the training loss of the last epoch."""
    states = f5_hidden_states(spark, sf_dir).where("layer = 1")
    targets = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") / 20).cast("int").alias("seq")).agg(
        (F.sum("label") % 2).cast("int").alias("label")
    )
    for k, (a, b) in enumerate(SPANS):
        targets = targets.withColumn(f"a{k}", F.lit(a)).withColumn(f"b{k}", F.lit(b))
    examples = T.span_examples(states, targets, [("a0", "b0"), ("a1", "b1")], ["seq"]).drop("seq")
    fitted = T.fit(examples, _PAIR, [T.Model(rate=RATE)], _plan(_PAIR_EPOCHS), scratch(spark, "pooler-fit"), first=T.from_parts(_PAIR, _pair_first()))
    w = _PAIR.views(fitted.theta)
    rows = [
        (k, i + 1, float(w["vp"][0, k, i]), float(w["bp"][0, k, i]), float(w["wp"][0, k, i].sum()), fitted.history[-1][0])
        for k in range(_PAIR.slots) for i in range(POOL)
    ]
    out = spark.createDataFrame(rows, "slot int, unit int, scorer double, bias double, weights double, loss double")
    return out.select("slot", "unit", F.round("scorer", 6).alias("scorer"), F.round("bias", 6).alias("bias"),
                      F.round("weights", 5).alias("weights"), F.round("loss", 6).alias("loss"))
