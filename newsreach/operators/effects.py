"""Distribution profiles and paired-cell effects.

A *cell* holds comparable rows (same company and type, same company and quarter, ...). Inside a cell the
median outcome with a flag is compared with the median without it; cells with fewer than ``min_n`` rows on
either side are left out. A win is strictly greater. Differences and ratios are then summarised over
cells by their medians, because means are ruled by outliers here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.moments import month_of, quarter_of
from newsreach.operators.ranks import HOT_ROWS, join_groups, mean_of, quantiles, rank_table, split_hot, values_at
from newsreach.sources.workspace import materialize

PROFILE = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def melt(df: DataFrame, metrics: Sequence[str], keep: Sequence[str] = (), name: str = "metric") -> DataFrame:
    """One row per input row and metric, with ``metric`` and ``value``."""
    pairs = [F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keep, F.inline(F.array(*pairs)))


def profile(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count, quantiles and standard deviation of each metric."""
    long = melt(df, metrics)
    spread = long.groupBy("metric").agg(F.stddev("value").alias("sd"))
    return quantiles(long, ["metric"], "value", PROFILE).join(spread, "metric")


def value_histogram(df: DataFrame, value: str) -> DataFrame:
    """Rows per value, and whether the value is the (lowest) mode."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    mode = counts.agg(F.min_by(value, F.struct(-F.col("rows"), F.col(value)))).scalar()
    return counts.withColumn("is_mode", F.col(value).eqNullSafe(mode))


def zero_rate(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows, share of zeros and maximum per metric."""
    return melt(df, metrics).groupBy("metric").agg(
        F.count("value").alias("n"),
        F.avg((F.col("value") == 0).cast("int")).alias("zero_rate"),
        F.max("value").alias("max_value"),
    )


def fill_rate(df: DataFrame, columns: Sequence[str], at: str, period: str = "month") -> DataFrame:
    """Share of rows per period in which each column is neither NULL nor empty."""
    start = F.trunc(F.col(at).cast("date"), period).alias("period")
    filled = [F.avg(F.coalesce(F.col(c) != "", F.lit(False)).cast("int")).alias(f"{c}_rate") for c in columns]
    return df.groupBy(start).agg(F.count(F.lit(1)).alias("rows"), *filled)


def activity_buckets(df: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Entities by how many rows they have, with their share."""
    per_entity = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("rows"))
    n = F.col("rows")
    bucket = F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    sizes = per_entity.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("entities"))
    # five rows at most
    whole = Window.partitionBy()
    return sizes.withColumn("share", F.col("entities") / F.sum("entities").over(whole))


def by_ordinal(
    df: DataFrame,
    entity: Sequence[str],
    at: str,
    tie: Sequence[str],
    outcomes: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Outcome by whether a row is the entity's first, second, third, ....

    The ordinal of a row in an ordinary entity is a window; in an entity above ``hot_rows`` rows it is
    the cumulative count of all rows before it by (moment, ties), cut into bands. A row without a moment
    has no ordinal and is left out, in an entity of any size.
    """
    order = [F.col(at), *[F.col(c) for c in tie]]
    ordinary, hot = split_hot(df.where(F.col(at).isNotNull()), entity, hot_rows)
    rows = ordinary.withColumn("ordinal", F.row_number().over(Window.partitionBy(*entity).orderBy(*order)))
    if hot is not None:
        rows = rows.unionByName(_hot_ordinals(hot, entity, order, hot_rows))
    long = melt(rows, outcomes, ["ordinal"])
    return quantiles(
        long, ["ordinal", "metric"], "value", {"median": 0.5}, extra={"mean": mean_of("value")}, hot_rows=hot_rows
    )


def _hot_ordinals(hot: DataFrame, entity: Sequence[str], order: Sequence[Column], hot_rows: int) -> DataFrame:
    """Ordinals from the ranks of (moment, ties), so that rows of one moment are split as well."""
    placed = hot.withColumn("__order", F.struct(*order))
    before = rank_table(placed, entity, "__order", hot_rows=hot_rows).select(*entity, "__order", F.col("before").alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*entity, "__order").orderBy("__order"))
    return (
        join_groups(placed.withColumn("__in", inside), before, [*entity, "__order"])
        .withColumn("ordinal", (F.col("__before") + F.col("__in")).cast("int"))
        .drop("__in", "__before", "__order")
    )


def paired_cells(
    df: DataFrame,
    cell: Sequence[str],
    flag: str,
    outcome: str,
    min_n: int = K.MIN_PER_SIDE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Both medians of every cell that has ``min_n`` rows on either side.

    Equal outcomes of a cell and side are counted before the shuffle, and a hot cell is split along its
    outcomes. Only two medians per cell travel on to the comparison.
    """
    rows = df.where(F.col(flag).isNotNull()).select(*cell, F.col(flag).alias("__flag"), F.col(outcome).alias("__value"))
    sides = quantiles(rows, [*cell, "__flag"], "__value", {"median": 0.5}, hot_rows=hot_rows)
    return compare_sides(sides, cell).where((F.col("n_with") >= min_n) & (F.col("n_without") >= min_n))


def compare_sides(sides: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Put the two sides of a cell (column ``__flag``) into one row."""
    yes = F.col("__flag")
    return sides.groupBy(*cell).agg(
        F.coalesce(F.max(F.when(yes, F.col("n"))), F.lit(0)).alias("n_with"),
        F.coalesce(F.max(F.when(~yes, F.col("n"))), F.lit(0)).alias("n_without"),
        F.max(F.when(yes, F.col("median"))).alias("median_with"),
        F.max(F.when(~yes, F.col("median"))).alias("median_without"),
    )


def summarize_cells(cells: DataFrame, by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cells, mean and median difference, win rate, median ratio over cells; optionally per group.

    A ratio with denominator zero is left out. All figures come from one table of counted differences and
    ratios, so the cells are computed once.
    """
    ratio = F.when(F.col("median_without") != 0, F.col("median_with") / F.col("median_without"))
    compared = cells.select(*by, (F.col("median_with") - F.col("median_without")).alias("difference"), ratio.alias("ratio"))
    wins = F.sum(F.when(F.col("value") > 0, F.col("cnt")).otherwise(F.lit(0))) / F.sum("cnt")
    figures = quantiles(
        melt(compared, ["difference", "ratio"], by), [*by, "metric"], "value", {"median": 0.5},
        extra={"mean": mean_of("value"), "wins": wins}, hot_rows=hot_rows,
    )

    def pick(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    return figures.groupBy(*by).agg(
        F.coalesce(pick("difference", "n"), F.lit(0)).alias("cells"),
        pick("difference", "mean").alias("mean_difference"),
        pick("difference", "wins").alias("win_rate"),
        pick("difference", "median").alias("median_difference"),
        pick("ratio", "median").alias("median_ratio"),
    )


def paired_effect(
    df: DataFrame,
    cell: Sequence[str],
    flag: str,
    outcome: str,
    min_n: int = K.MIN_PER_SIDE,
    by: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Effect of ``flag`` on ``outcome`` inside comparable cells."""
    return summarize_cells(paired_cells(df, [*by, *cell], flag, outcome, min_n, hot_rows), by, hot_rows)


def accepted(effects: DataFrame) -> DataFrame:
    """Mark effects that pass the published rule: win rate and median ratio both high enough."""
    good = (F.col("win_rate") >= K.WIN_RATE_MIN) & (F.col("median_ratio") >= K.RATIO_MIN)
    return effects.withColumn("accepted", F.coalesce(good, F.lit(False)))


def month_normalized(df: DataFrame, at: str, outcome: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Divide an outcome by the median of its month, which removes a trend over time."""
    dated = df.withColumn("__month", month_of(at))
    medians = quantiles(dated.select("__month", outcome), ["__month"], outcome, {"__median": 0.5}, hot_rows=hot_rows)
    medians = medians.select("__month", "__median")
    value = F.when(F.col("__median") != 0, F.col(outcome) / F.col("__median"))
    return join_groups(dated, medians, ["__month"], "left").withColumn(out, value).drop("__month", "__median")


def timed_effect(
    df: DataFrame,
    cell: Sequence[str],
    flag: str,
    outcome: str,
    at: str,
    min_n: int = K.MIN_PER_SIDE,
    normalize: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Effect with time controlled: the quarter joins the cell, the outcome is relative to its month."""
    rows = month_normalized(df, at, outcome, "__relative", hot_rows) if normalize else df.withColumn("__relative", F.col(outcome))
    return paired_effect(
        rows.withColumn("__quarter", quarter_of(at)), [*cell, "__quarter"], flag, "__relative", min_n, hot_rows=hot_rows
    )


def recent_effect(
    df: DataFrame, cell: Sequence[str], outcome: str, at: str, months: int = 3, min_n: int = K.MIN_PER_SIDE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Effect of being recent: the last ``months`` months against everything earlier."""
    latest = df.agg(F.max(at)).scalar()
    recent = F.col(at) >= F.add_months(F.col("__latest").cast("date"), -months)
    return paired_effect(
        df.withColumn("__latest", latest).withColumn("__recent", recent), cell, "__recent", outcome, min_n,
        hot_rows=hot_rows,
    )


def against_rest(
    own: DataFrame, whole: DataFrame, cell: Sequence[str], group: str, min_n: int = K.MIN_PER_SIDE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Medians of each group of a cell and of all other rows of the cell, for groups with ``min_n`` rows on either side.

    ``whole`` has the counted outcomes of the cells (``__value``, ``__c``), ``own`` those of the groups, which are a part of
    them. The other rows are never built: of two cumulative tables, below an outcome lie as many of them as the cell has
    less those of the group. So the group's own outcomes tell how many of its rows lie before the middle of the
    others, which gives the place of that middle in the cell. Work and rows grow with the distinct outcomes of both.
    """
    cells = materialize(rank_table(whole, cell, "__value", "__c", hot_rows), "cell-ranks")
    ranked = rank_table(own, [*cell, group], "__value", "__c", hot_rows)
    mine = ranked.withColumnsRenamed({"cnt": "__cnt", "before": "__before", "n": "__n"})
    rest = F.col("n") - F.col("__n")
    met = join_groups(mine, cells, [*cell, "__value"]).withColumn("__rest", rest).where((F.col("__n") >= min_n) & (rest >= min_n))
    upto, others = F.col("__before") + F.col("__cnt"), F.col("before") + F.col("cnt") - F.col("__before") - F.col("__cnt")
    picks = []
    for side, size in (("own", F.col("__n")), ("rest", F.col("__rest"))):
        for end, place in (("low", F.floor((size - 1) / 2)), ("high", F.ceil((size - 1) / 2))):
            if side == "own":
                found = F.max(F.when((F.col("__before") <= place) & (place < upto), F.col("__value")))
            else:
                found = F.max(place) + F.coalesce(F.max(F.when(others <= place, upto)), F.lit(0))
            picks.append(found.alias(f"{side}_{end}"))
    places = met.groupBy(*cell, group).agg(F.max("__n").alias("n_with"), F.max("__rest").alias("n_without"), *picks)
    asked = places.select(
        *cell, group, "n_with", "n_without", (F.col("own_low") + (F.col("own_high") - F.col("own_low")) / 2).alias("median_with"),
        F.explode(F.array("rest_low", "rest_high")).alias("__place"),
    )
    found = values_at(cells, asked, cell, "__value", "__place", hot_rows)
    low, high = F.min("__value"), F.max("__value")
    return found.groupBy(*cell, group).agg(
        F.max("n_with").alias("n_with"), F.max("n_without").alias("n_without"), F.max("median_with").alias("median_with"),
        (low + (high - low) / 2).alias("median_without"),
    )


def one_vs_rest(
    df: DataFrame, cell: Sequence[str], group: str, outcome: str, min_n: int = K.MIN_PER_SIDE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every value of ``group``: its rows against the other rows of the same cell.

    Equal outcomes of a cell and group are counted first, and the outcomes of a cell from those counts.
    """
    value = F.col(outcome).cast("double")
    counts = materialize(
        df.where(F.col(outcome).isNotNull() & F.col(group).isNotNull())
        .groupBy(*cell, F.col(group), value.alias("__value"))
        .agg(F.count(F.lit(1)).alias("__c")),
        "outcomes",
    )
    return summarize_cells(against_rest(counts, counts, cell, group, min_n, hot_rows), [group], hot_rows)


def rate_contrast(cases: DataFrame, media: DataFrame, keys: Sequence[str], flag: str, outlet: str) -> DataFrame:
    """Presence rate of each outlet with and without the flag, and the gap in percentage points."""
    sizes = cases.agg(F.count_if(F.col(flag)).alias("with"), F.count_if(~F.col(flag)).alias("without"))
    hits = (
        media.select(*keys, outlet)
        .distinct()
        .join(cases.select(*keys, flag), list(keys))
        .groupBy(outlet)
        .agg(F.count_if(F.col(flag)).alias("cases_with"), F.count_if(~F.col(flag)).alias("cases_without"))
    )
    rate_with = F.col("cases_with") / sizes.select("with").scalar()
    rate_without = F.col("cases_without") / sizes.select("without").scalar()
    return hits.withColumn("gap_points", (rate_with - rate_without) * 100)


def segment_effect(
    df: DataFrame, segment: Sequence[str], flag: str, outcome: str, min_n: int = K.MIN_SEGMENT_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Medians with and without the flag per segment, for segments large enough on both sides."""
    cells = paired_cells(df, segment, flag, outcome, min_n, hot_rows)
    return cells.withColumn("difference", F.col("median_with") - F.col("median_without"))


def found_terms(text: str, terms: Sequence[str]) -> Column:
    """Array of the listed terms that occur in the text."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda term: F.contains(F.col(text), term))


def term_effect(
    df: DataFrame, text: str, terms: Sequence[str], cell: Sequence[str], outcome: str,
    min_n: int = K.MIN_PER_SIDE, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Paired-cell effect of each term of a list.

    The texts are read once; from then on a row holds the few terms it contains. A term meets only its own counted
    outcomes of a cell; those without it follow from the counts of the cell.
    """
    found = df.where(F.col(text).isNotNull() & F.col(outcome).isNotNull()).select(
        *cell, F.col(outcome).cast("double").alias("__value"), found_terms(text, terms).alias("__found")
    )
    rows = materialize(found.groupBy(*cell, "__value", "__found").agg(F.count(F.lit(1)).alias("__c")), "terms")
    own = rows.select(*cell, "__value", "__c", F.explode(F.array_distinct("__found")).alias("term"))
    return summarize_cells(against_rest(own, rows, cell, "term", min_n, hot_rows), ["term"], hot_rows)


def effect_correlation(left: DataFrame, right: DataFrame, on: str = "term", value: str = "win_rate") -> DataFrame:
    """Correlation of two effects across terms, with the number of terms."""
    both = left.select(on, F.col(value).alias("__a")).join(right.select(on, F.col(value).alias("__b")), on)
    return both.agg(F.count(F.lit(1)).alias("terms"), F.corr("__a", "__b").alias("correlation"))


def metric_correlation(df: DataFrame, metrics: Sequence[str], size: str) -> DataFrame:
    """Pearson correlation of each metric with the size of the entity."""
    return melt(df, metrics, [size]).groupBy("metric").agg(F.corr("value", size).alias("correlation"))


def entity_size_correlation(df: DataFrame, entity: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Correlation of each metric with the number of rows of its entity.

    Works on sums per entity, so that neither rows nor entities have to meet again.
    """
    x = F.col("value")
    sums = (
        melt(df.dropna(subset=list(metrics)), metrics, entity)
        .groupBy("metric", *entity)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    )
    n, size = F.col("n"), F.col("n")
    total = sums.groupBy("metric").agg(
        F.sum(n).alias("N"),
        F.sum("sx").alias("X"),
        F.sum("sxx").alias("XX"),
        F.sum(n * size).alias("Y"),
        F.sum(n * size * size).alias("YY"),
        F.sum(F.col("sx") * size).alias("XY"),
    )
    covariance = F.col("N") * F.col("XY") - F.col("X") * F.col("Y")
    spread = (F.col("N") * F.col("XX") - F.col("X") ** 2) * (F.col("N") * F.col("YY") - F.col("Y") ** 2)
    return total.select("metric", F.try_divide(covariance, F.sqrt(spread)).alias("correlation"))


def term_position(df: DataFrame, text: str, term: str, metrics: Sequence[str]) -> DataFrame:
    """Mean percentile position (0 = top) of the rows that mention a term, per metric."""
    flagged = df.withColumn("__hit", F.coalesce(F.contains(F.col(text), F.lit(term)), F.lit(False)).cast("int"))
    long = melt(flagged, metrics, ["__hit"]).withColumn("value", -F.col("value"))
    table = rank_table(long, ["metric"], "value").select(
        "metric",
        "value",
        F.when(F.col("n") > 1, F.col("before") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("position"),
    )
    # hits per distinct value first: a value shared by many rows meets the table once
    hits = long.where(F.col("__hit") == 1).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("hits"))
    return (
        hits.join(table, ["metric", "value"])
        .groupBy("metric")
        .agg(
            F.sum("hits").alias("rows"),
            (F.sum(F.col("hits") * F.col("position")) / F.sum("hits")).alias("mean_position"),
        )
    )


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the left table, and the share of them that the right table has."""
    sides = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    per_key = sides.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r")).where("__l = 1")
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.sum("__r").alias("matched"), F.avg("__r").alias("coverage")
    )


def regional_supply(lift: DataFrame, place: str, outlet: str, lift_min: float = K.LIFT_MIN) -> DataFrame:
    """Regional outlets of each place and how many listings they carry."""
    return (
        lift.where(F.col("lift") >= lift_min)
        .groupBy(place)
        .agg(F.count(outlet).alias("outlets"), F.sum("hits").alias("listings"))
    )

