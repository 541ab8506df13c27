"""Ordered scans within groups on built-in windows: positions, running sums,
running min/max, with hot groups split.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task; a
query holding a third of all rows would then be scanned by a single core. So
groups that hold more than one range's share of all rows are cut into ranges
of the leading order column (by its quantiles within the group), the window
runs per (group, range), and the totals of a group's earlier ranges are added.
All other groups are one window each, in the same plan.

The tables that steer this are bounded by the number of ranges, not by the
data: at most ``ranges`` groups can hold more than ``rows / ranges`` rows, and
they have at most ``2 * ranges`` ranges together.

The order must be total (add a unique tie-break), otherwise positions among
equal keys are arbitrary. Rows of a hot group that are also equal in the
leading order column stay in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "pos"


def _order(names: Sequence[str]) -> list[Column]:
    """``name`` ascending (nulls first), ``-name`` descending (nulls last)."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in names]


def _lead_key(df: DataFrame, name: str) -> Column:
    """A number that grows with the leading order column (not strictly)."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    head = F.hex(F.rpad(F.substring(c.cast("string").cast("binary"), 1, 6), 6, F.lit(b"\0")))
    return F.conv(head, 16, 10).cast("double")


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & x.eqNullSafe(y)
    return out


def _hot_ranges(keys: DataFrame, group: list[str], lead: Column, ranges: int) -> DataFrame | None:
    """``_g0.., _bounds``: the groups with more than a range's share of the
    rows, and the bounds that cut each into ranges of about that share."""
    rows = keys.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], lead.alias("_key"))
    names = [f"_g{i}" for i in range(len(group))]
    total = rows.count()
    share = max(1.0, total / ranges)
    # at most `ranges` groups can be above the share
    big = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * share)
    hot = big.orderBy(F.desc("_n")).limit(ranges).collect()
    if not hot:
        return None
    spark = keys.sparkSession
    table = spark.createDataFrame([tuple(r) for r in hot], big.schema)
    grid = max(2, min(ranges, int(max(r["_n"] for r in hot) / share) + 1))
    marks = [i / grid for i in range(1, grid)]
    if names:
        picked = rows.join(F.broadcast(table.select(*[F.col(n).alias(f"_h{n}") for n in names])),
                           _same([F.col(n) for n in names], [F.col(f"_h{n}") for n in names]))
    else:
        picked = rows
    got = picked.groupBy(*names).agg(F.percentile_approx("_key", marks, 20 * grid).alias("_q")).collect()
    size = {tuple(r[n] for n in names): r["_n"] for r in hot}
    out = []
    for r in got:
        key = tuple(r[n] for n in names)
        pieces = min(grid, int(size[key] / share) + 1)
        q = r["_q"] or []
        out.append((*key, sorted({float(q[min(len(q) - 1, j * grid // pieces - 1)]) for j in range(1, pieces)} if q else set())))
    schema = T.StructType([*[f for f in big.schema.fields if f.name != "_n"], T.StructField("_bounds", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(out, schema)


def segmented_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
    maxs: Sequence[str] = (),
    before_mins: Sequence[str] = (),
    num_partitions: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``pos`` (1-based position within ``group`` by ``order``) and, per
    column ``c``: ``cum_c`` (running sum), ``runmin_c``, ``runmax_c``, all
    inclusive of the current row, and ``prevmin_c`` for ``before_mins``: the
    minimum of the earlier rows only. Nulls and NaN add nothing and change no
    bound. ``order`` names columns, with a leading ``-`` for descending.

    ``keys`` may be a cheaper frame with the same rows' group and leading
    order columns (the run before it was judged), used to find hot groups."""
    group, order = list(group), list(order)
    ranges = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead_name = order[0].lstrip("-")
    source = keys if keys is not None else df
    hot = _hot_ranges(source, group, _lead_key(source, lead_name), ranges)
    columns = df.columns
    if hot is None:
        rows = df.withColumn("_r", F.lit(0))
    else:
        joined = df.join(F.broadcast(hot), _same([F.col(g) for g in group], [F.col(f"_g{i}") for i in range(len(group))]), "left")
        below = F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))
        above = F.size("_bounds") - F.when(F.col("_key").isNull(), 0).otherwise(below)
        place = above if order[0].startswith("-") else F.when(F.col("_key").isNull(), 0).otherwise(below)
        rows = joined.withColumn("_key", _lead_key(df, lead_name)).withColumn(
            "_r", F.when(F.col("_bounds").isNull(), -1).otherwise(place)
        )
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in {*sums, *mins, *maxs, *before_mins}}
    within = Window.partitionBy(*group, "_r").orderBy(*_order(order))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        "*",
        F.row_number().over(within).cast("long").alias(POS),
        *[F.sum(F.coalesce(number[c], F.lit(0.0))).over(running).alias(f"cum_{c}") for c in sums],
        *[F.min(number[c]).over(running).alias(f"runmin_{c}") for c in mins],
        *[F.max(number[c]).over(running).alias(f"runmax_{c}") for c in maxs],
        *[F.min(number[c]).over(earlier).alias(f"prevmin_{c}") for c in before_mins],
    )
    added = [POS, *[f"cum_{c}" for c in sums], *[f"runmin_{c}" for c in mins], *[f"runmax_{c}" for c in maxs], *[f"prevmin_{c}" for c in before_mins]]
    if hot is None:
        return out.select(*columns, *added)
    # totals of the earlier ranges of each hot group
    names = [f"_o{i}" for i in range(len(group))]
    stats = rows.where("_r >= 0").groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("_r").alias("_or")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(number[c]).alias(f"_s_{c}") for c in sums],
        *[F.min(number[c]).alias(f"_mn_{c}") for c in {*mins, *before_mins}],
        *[F.max(number[c]).alias(f"_mx_{c}") for c in maxs],
    )
    before = Window.partitionBy(*names).orderBy("_or").rowsBetween(Window.unboundedPreceding, -1)
    carried = stats.select(
        *names, "_or",
        F.sum("_n").over(before).alias(f"_b_{POS}"),
        *[F.sum(f"_s_{c}").over(before).alias(f"_b_cum_{c}") for c in sums],
        *[F.min(f"_mn_{c}").over(before).alias(f"_b_runmin_{c}") for c in mins],
        *[F.max(f"_mx_{c}").over(before).alias(f"_b_runmax_{c}") for c in maxs],
        *[F.min(f"_mn_{c}").over(before).alias(f"_b_prevmin_{c}") for c in before_mins],
    )
    on = _same([F.col(g) for g in group], [F.col(n) for n in names]) & (F.col("_r") == F.col("_or"))
    out = out.join(F.broadcast(carried), on, "left")  # one row per range of a hot group
    total = lambda c: (F.col(c) + F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(c)
    return out.select(
        *columns,
        total(POS),
        *[total(f"cum_{c}") for c in sums],
        *[F.least(f"runmin_{c}", f"_b_runmin_{c}").alias(f"runmin_{c}") for c in mins],
        *[F.greatest(f"runmax_{c}", f"_b_runmax_{c}").alias(f"runmax_{c}") for c in maxs],
        *[F.least(f"prevmin_{c}", f"_b_prevmin_{c}").alias(f"prevmin_{c}") for c in before_mins],
    )


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank", **kw) -> DataFrame:
    """Exact 1-based ``row_number`` within ``group`` by a total ``order``."""
    return segmented_scan(df, group, order, **kw).withColumnRenamed(POS, name)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their position. Spark cuts
    each group to ``k`` rows in every task before the shuffle, so no group is
    gathered whole."""
    w = Window.partitionBy(*group).orderBy(*_order(order))
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", **kw) -> DataFrame:
    """Exact 1-based ``row_number`` over the whole table without a
    one-partition window."""
    return group_rank(df, [], order, name=name, **kw)
