"""Free text to place id (J9) and name leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.text import bare_name, short_place
from newsreach.sources.workspace import materialize

# Characters of the longest run that a name is known by
LONGEST_RUN = 32


def _grams(text: Column, single: bool) -> Column:
    """Distinct neighbouring character pairs of a text, and with ``single`` its characters too; one pass over the text."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))"), 1)
    return F.array_distinct(F.concat(pairs, F.regexp_extract_all(text, F.lit(r"(?s)(.)"), 1)) if single else pairs)


def _run_length(characters: Column) -> Column:
    """The largest power of two up to the number of characters and ``LONGEST_RUN``, for a number of at least 1."""
    found = F.lit(LONGEST_RUN)
    size = LONGEST_RUN // 2
    while size:
        found, size = F.when(characters < 2 * size, F.lit(size)).otherwise(found), size // 2
    return found


def _runs(text: Column, lengths: Sequence[int], own: bool = False) -> Column:
    """Distinct runs of neighbouring characters of the given lengths; with ``own`` only those of the text's own run length."""
    size = _run_length(F.length(text))
    parts = {n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))" if n > 1 else "(?s)(.)"), 1) for n in lengths if own or n > 2}
    if own:
        return F.array_distinct(F.coalesce(*[F.when(size == n, part) for n, part in parts.items()], F.array().cast("array<string>")))
    short = [_grams(text, 1 in lengths)] if min(lengths, default=2) <= 2 else []
    return F.array_distinct(F.concat(*short, *parts.values()))


def _meetings(read: DataFrame, text: str, known: DataFrame, name: str, on: Sequence[str]) -> DataFrame:
    """(on, ``__key``, name) of the texts and names that share the run the name is known by."""
    keys = [*on, name]
    lengths = [r[0] for r in known.select(_run_length(F.length(name))).distinct().collect()]
    each = known.select(*keys, F.explode(_runs(F.col(name), lengths, True)).alias("__run"))
    counted = each.join(each.groupBy("__run").agg(F.count(F.lit(1)).alias("__held")), "__run")
    index = counted.groupBy(*keys).agg(F.min_by("__run", F.struct("__held", "__run")).alias("__run"))
    runs = read.select(*on, "__key", F.explode(_runs(F.col(text), lengths)).alias("__run"))
    return runs.join(index, [*on, "__run"]).select(*on, "__key", name).distinct()


def names_in_text(texts: DataFrame, text: str, names: DataFrame, name: str, on: Sequence[str] = ()) -> DataFrame:
    """All (text, name) pairs where the name occurs in the text, for distinct texts and names, with the names' other columns.

    "Contains" as an equi-join: each name is known by its rarest run of characters, counted over the names. Runs are as
    long as the largest power of two that fits the name, ``LONGEST_RUN`` at most, so names that differ anywhere have
    runs of their own, however alike they begin or end. A text is cut into its runs of the lengths that occur, which
    meet only the names that are known by one of them, and each of those is looked for in the text. So a text costs a
    row for each character and length, and is itself carried once. With ``on``, texts and names must agree in these columns.
    """
    keys = [*on, name]
    known = materialize(names.where(F.col(name) != "").select(*keys).distinct(), "names")
    read = texts.where(F.col(text) != "").select(*on, text).distinct().withColumn("__key", F.xxhash64(*on, text))
    # Two texts under one key are both looked at.
    found = _meetings(read, text, known, name, on).join(
        read.select(F.col("__key").alias("__read"), text), (F.col("__key") == F.col("__read")) & F.contains(F.col(text), F.col(name))
    )
    return found.select(*on, text, name).join(names, keys)


def resolve_place(df: DataFrame, text: str, places: DataFrame, out: str = "prefecture_id") -> DataFrame:
    """Add the place id that a free text points to, or NULL.

    Tried in this order: (1) full prefecture names, lowest id first; (2) prefecture names without their
    suffix; (3) city names, where the prefecture with most matching names wins and a tie gives NULL.
    ``places`` has ``kind``, ``name`` and ``prefecture_id``.
    """
    prefectures = places.where(F.col("kind") == "prefecture")
    stages = F.array(
        F.struct(F.lit(1).alias("stage"), F.col("name").alias("label")),
        F.struct(F.lit(2).alias("stage"), short_place("name").alias("label")),
    )
    labels = (
        prefectures.select(F.col("prefecture_id"), F.inline(stages))
        .unionByName(
            places.where(F.col("kind") == "city").select(
                "prefecture_id", F.lit(3).alias("stage"), F.col("name").alias("label")
            )
        )
        .select("prefecture_id", "stage", "label")
    )
    votes = (
        names_in_text(df.select(F.col(text).alias("__text")), "__text", labels, "label")
        .groupBy("__text", "stage", "prefecture_id")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # one entry per prefecture at most, so the array is bounded by the number of prefectures
    cities = F.sort_array(
        F.collect_list(F.when(F.col("stage") == 3, F.struct("votes", "prefecture_id"))), asc=False
    )
    found = votes.groupBy("__text").agg(
        F.min(F.when(F.col("stage") == 1, F.col("prefecture_id"))).alias("full"),
        F.min(F.when(F.col("stage") == 2, F.col("prefecture_id"))).alias("short"),
        cities.alias("cities"),
    )
    first, second = F.get("cities", F.lit(0)), F.get("cities", F.lit(1))
    tied = F.coalesce(first["votes"] == second["votes"], F.lit(False))
    city = F.when(~tied, first["prefecture_id"])
    resolved = found.select("__text", F.coalesce("full", "short", city).alias(out))
    return df.join(resolved, F.col(text) == F.col("__text"), "left").drop("__text")


def name_leaks(
    proposals: DataFrame,
    cases: DataFrame,
    case_set: Sequence[str],
    proposal: Sequence[str],
    text: str,
    company: str,
) -> DataFrame:
    """Proposals that mention a company of the cases they were drawn from, counted per case set.

    Names lose their legal form and must keep two characters. As in ``names_in_text`` the test is an
    equi-join, here on case set and runs together, so neither side is paired with the whole of the other.
    """
    names = (
        cases.where(F.col(company) != "")
        .select(*case_set, bare_name(company).alias("__name"))
        .where(F.length("__name") >= K.MIN_NAME_LENGTH)
        .distinct()
    )
    found = names_in_text(proposals, text, names, "__name", case_set).select(*case_set, text).distinct()
    leaked = found.withColumn("__leak", F.lit(1))
    return (
        proposals.select(*case_set, *proposal, text)
        .join(leaked, [*case_set, text], "left")
        .groupBy(*case_set)
        .agg(F.count(F.lit(1)).alias("proposals"), F.count("__leak").alias("leaks"))
    )
