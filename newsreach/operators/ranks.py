"""Exact ranks and quantiles that survive hot groups and global scope.

A window over ``partitionBy(group)`` or an exact ``percentile`` puts a whole group into one task. That is
fine for ordinary groups and fatal for one that holds a third of the table, or for a rank over all rows.
``rank_table`` is the one primitive behind every rank, median and quantile here:

1. Equal values of a group are counted, map-side first; a value shared by many rows becomes one row. The
   counts are written to the shared folder, so everything that feeds them is computed once.
2. The group sizes are measured on the stored counts. Groups of at most ``HOT_ROWS`` distinct values take
   a plain window, whose size is thereby bounded. A short table needs no more than its row count for that.
3. Larger groups, if there are any, are cut into bands of about equally many distinct values: Spark samples
   the counted table for splitters and deals its rows by (group, value) range. The band of each row is written
   with it. A cumulative count runs inside each band and the count of all lower bands is added. Any type that
   has an order will do, also a struct of a moment and what breaks its ties. The list of such groups is a
   stored table of known size, so Spark broadcasts it when it is small and shuffles otherwise.

Bands are stored, so a task that is computed again after a loss reads the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach.sources.workspace import materialize

HOT_ROWS = 1_000_000

# Distinct values of a band of a hot group, about
BAND_ROWS = 250_000
LEAST_BANDS = 8


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL is a key value like any other; key columns come from the left."""
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = None
    for key in keys:
        pair = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = pair if condition is None else condition & pair
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def _same(group: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for position, name in enumerate(group):
        pair = F.col(name).eqNullSafe(F.col(prefix + name))
        condition = pair if position == 0 else condition & pair
    return condition


def hot_keys(stored: DataFrame, group: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys (renamed to ``__h_...``) of groups above ``hot_rows`` rows, or None if there is no such group.

    ``stored`` is a stored table; its row count comes from the file footers.
    """
    if stored.count() <= hot_rows:
        return None
    keys = [F.col(name).alias(f"__h_{name}") for name in group]
    hot = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    found = materialize(hot, "hot-groups")
    return found if found.count() else None


def split_hot(
    df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of groups with more than ``hot_rows`` rows if there are any.

    The rows are stored first, so that whatever computes them runs once.
    """
    stored = materialize(df, "ranked-rows")
    hot = hot_keys(stored, group, hot_rows)
    if hot is None:
        return stored, None
    same = _same(group, "__h_")
    return stored.join(hot, same, "left_anti"), stored.join(hot, same, "left_semi")


def banded(rows: DataFrame, group: Sequence[str], value: str, size: int) -> DataFrame:
    """The rows with a stored ``__band`` that ascends with (group, value); ``size`` is their number."""
    bands = max(LEAST_BANDS, -(-size // BAND_ROWS))
    ranged = rows.repartitionByRange(bands, *[F.col(name) for name in [*group, value]])
    return materialize(ranged.withColumn("__band", F.spark_partition_id()), "bands")


def rank_table(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    weight: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per group and distinct value: ``cnt`` rows, ``before`` rows with a smaller value, group size ``n``.

    NULL values are left out, as in every rank of the library. ``weight`` counts a row more than once.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value)).agg(amount.alias("cnt")), "counts"
    )
    hot = hot_keys(counts, group, hot_rows)
    if hot is None:
        return _windowed(counts, group, value)
    size = hot.agg(F.sum("__rows")).first()[0]
    if not group:
        return _cumulated(banded(counts, group, value, size), group, value)
    same = _same(group, "__h_")
    large = _cumulated(banded(counts.join(hot, same, "left_semi"), group, value, size), group, value)
    return _windowed(counts.join(hot, same, "left_anti"), group, value).unionByName(large)


def _windowed(counts: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    whole = Window.partitionBy(*group)
    upto = F.sum("cnt").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(*group, value, "cnt", (upto - F.col("cnt")).alias("before"), F.sum("cnt").over(whole).alias("n"))


def _cumulated(marked: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Ranks from cumulative counts inside the bands and over the bands of a group, of which there are few."""
    start, here = Window.unboundedPreceding, Window.currentRow
    inside = Window.partitionBy(*group, "__band").orderBy(value).rowsBetween(start, here)
    running = marked.withColumn("__inside", F.sum("cnt").over(inside) - F.col("cnt"))
    lower = Window.partitionBy(*group).orderBy("__band").rowsBetween(start, here)
    below = (
        marked.groupBy(*group, "__band")
        .agg(F.sum("cnt").alias("__total"))
        .select(
            *[F.col(name).alias(f"__b_{name}") for name in [*group, "__band"]],
            (F.sum("__total").over(lower) - F.col("__total")).alias("__below"),
            F.sum("__total").over(Window.partitionBy(*group)).alias("n"),
        )
    )
    placed = running.join(below, _same([*group, "__band"], "__b_"))
    return placed.select(*group, value, "cnt", (F.col("__below") + F.col("__inside")).alias("before"), "n")


def with_ranks(df: DataFrame, group: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with ``cnt``, ``before`` and ``n`` of ``rank_table`` for their value.

    The rows are stored once and measured. If no group has more than ``hot_rows`` of them, one window adds the
    figures; otherwise the counted values are ranked and joined to the rows. Only for a row with a value do
    the figures mean anything.
    """
    stored = materialize(df, "ranked-rows")
    if hot_keys(stored, group, hot_rows) is None:
        whole = Window.partitionBy(*group)
        ordered = whole.orderBy(F.col(value).asc_nulls_last())
        before = F.rank().over(ordered) - 1
        upto = F.count(value).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return stored.withColumns({"__upto": upto, "before": before.cast("long"), "n": F.count(value).over(whole)}).withColumn(
            "cnt", F.col("__upto") - F.col("before")
        ).drop("__upto")
    table = rank_table(stored, group, value, hot_rows=hot_rows)
    return join_groups(stored, table, [*group, value], "left")


def positions(df: DataFrame, value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with the number of rows of smaller ``value`` (``out``) and the row count ``n``; the same as ``before`` and ``n`` of ``with_ranks``.

    For values that hardly repeat and are never NULL. The rows travel once, into sorted bands of a range; a row's place in its band and
    the rows of the lower bands give its number. Equal values meet in one band and share the first place.
    """
    size = df.count()
    if size <= hot_rows:
        return with_ranks(df, [], value, hot_rows).withColumnRenamed("before", out).drop("cnt")
    bands = max(LEAST_BANDS, -(-size // BAND_ROWS))
    ranged = df.repartitionByRange(bands, value).sortWithinPartitions(value)
    placed = ranged.withColumns({"__band": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    # the low 33 bits of the id count the rows of a partition
    first = F.min(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).over(Window.partitionBy(value))
    stored = materialize(placed.withColumn("__inside", first).drop("__at"), "bands")
    lower = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = stored.groupBy(F.col("__band").alias("__b")).agg(F.count(F.lit(1)).alias("__rows"))
    below = totals.select("__b", (F.sum("__rows").over(lower) - F.col("__rows")).alias("__below"))
    below = materialize(below, "band-sizes")
    found = stored.join(F.broadcast(below), F.col("__band") == F.col("__b"))
    return found.withColumns({out: F.col("__below") + F.col("__inside"), "n": F.lit(size).cast("long")}).drop("__band", "__b", "__inside", "__below")


def values_at(
    table: DataFrame, asked: DataFrame, group: Sequence[str], value: str, place: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows of ``asked`` with the ``value`` that stands at position ``place`` (from 0) of their group.

    ``table`` is a rank table of the groups. Both are merged along the positions; each row takes the last value at
    or before its own. Rows of a hot group are cut into bands, and a band begins with the last value of those below.
    """
    rest = [c for c in asked.columns if c not in (*group, place)]
    types = {field.name: field.dataType for field in asked.schema}
    marks = table.select(*group, F.col("before").cast("long").alias("__at"), F.lit(0).alias("__kind"), value, *[F.lit(None).cast(types[c]).alias(c) for c in rest])
    wants = asked.select(*group, F.col(place).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(table.schema[value].dataType).alias(value), *rest)
    merged = materialize(marks.unionByName(wants), "positions")
    order = ["__at", "__kind"]
    start, here = Window.unboundedPreceding, Window.currentRow

    def last(keys: Sequence[str], of: str, by: Sequence[str]) -> Column:
        return F.last(of, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(start, here))

    hot = hot_keys(merged, group, hot_rows)
    if hot is None:
        found = merged.withColumn("__found", last(group, value, order))
    else:
        size = hot.agg(F.sum("__rows")).first()[0]
        bands = max(LEAST_BANDS, -(-size // BAND_ROWS))
        ranged = merged.repartitionByRange(bands, *[F.col(c) for c in [*group, *order]]).withColumn("__band", F.spark_partition_id())
        ranged = materialize(ranged, "bands")
        ends = ranged.groupBy(*group, "__band").agg(F.max_by(value, F.when(F.col("__kind") == 0, F.col("__at"))).alias("__end"))
        ends = ends.withColumn("__first", F.lag(last(group, "__end", ["__band"])).over(Window.partitionBy(*group).orderBy("__band")))
        inside = ranged.withColumn("__inside", last([*group, "__band"], value, order))
        found = join_groups(inside, ends.select(*group, "__band", "__first"), [*group, "__band"]).withColumn("__found", F.coalesce("__inside", "__first"))
    return found.where("__kind = 1").select(*group, F.col("__at").alias(place), *rest, F.col("__found").alias(value))


def average_rank(cnt: str = "cnt", before: str = "before") -> Column:
    """Rank 1..n in which equal values share their mean rank."""
    return F.col(before) + (F.col(cnt) + 1) / 2


def mid_percentile() -> Column:
    """Mean of ``percent_rank`` and ``cume_dist`` from the columns of ``rank_table``."""
    low = F.when(F.col("n") > 1, F.col("before") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    high = (F.col("before") + F.col("cnt")) / F.col("n")
    return (low + high) / 2


def _add_rank(df: DataFrame, group: Sequence[str], value: str, out: str, figure: Column, hot_rows: int) -> DataFrame:
    ranked = with_ranks(df, group, value, hot_rows)
    return ranked.select(*[c for c in df.columns if c != out], F.when(F.col(value).isNotNull(), figure).alias(out))


def midrank(df: DataFrame, group: Sequence[str], value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the mid-rank percentile of ``value`` inside ``group``.

    0 is the lowest, 1 the highest, ties share the middle, a group of one gets 0.5. NULL group keys form
    one group. A row whose value is NULL gets NULL and does not count for the others, whatever the size of
    its group. The rows are stored for it once, so pass no more columns than needed.
    """
    return _add_rank(df, group, value, out, mid_percentile(), hot_rows)


def avg_rank(df: DataFrame, value: str, out: str, group: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the rank of ``value`` over all rows (or per group), ties averaged."""
    return _add_rank(df, group, value, out, average_rank(), hot_rows)


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    weight: str | None = None,
    extra: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group, with the count ``n`` of its non-NULL rows.

    ``extra`` are further aggregates over the distinct values, each of which stands for ``cnt`` rows.
    """
    table = rank_table(df, group, value, weight, hot_rows)
    number, start, end = F.col(value).cast("double"), F.col("before"), F.col("before") + F.col("cnt")
    picks, results = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.max(F.when((start <= low) & (low < end), number)).alias(f"__lo_{name}"),
            F.max(F.when((start <= high) & (high < end), number)).alias(f"__hi_{name}"),
            F.max(position - low).alias(f"__f_{name}"),
        ]
        low_value, high_value = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        results.append((low_value + (high_value - low_value) * F.col(f"__f_{name}")).alias(name))
    more = dict(extra or {})
    found = table.groupBy(*group).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks, *[c.alias(name) for name, c in more.items()]
    )
    return found.select(*group, "n", *results, *more)


def mean_of(value: str) -> Column:
    """Mean over the rows behind the distinct values of a rank table."""
    return F.sum(F.col(value).cast("double") * F.col("cnt")) / F.sum("cnt")
