"""Draft fields: which are filled, which are still open, how answers settle them.

A draft row has one column per field (``partner`` is an array, the others are texts) and the arrays
``skipped`` and ``retried`` with field codes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsreach import constants as K

LIST_FIELDS = ("partner",)

DRAFT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("start_date", T.StringType()),
        *(
            T.StructField(code, T.ArrayType(T.StringType()) if code in LIST_FIELDS else T.StringType())
            for code in K.FIELD_ORDER
        ),
        T.StructField("skipped", T.ArrayType(T.StringType())),
        T.StructField("retried", T.ArrayType(T.StringType())),
    ]
)


def _codes(test: Callable[[str], Column]) -> Column:
    """Codes of the fields that pass ``test``, in asking order."""
    picked = [F.when(test(code), F.lit(code)) for code in K.FIELD_ORDER]
    return F.array_compact(F.array(*picked))


def _set(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))


def parse_draft(text: Column | str) -> Column:
    """Read a stored draft; NULL when it is absent, unreadable or holds a field of a wrong type."""
    schema = T.StructType([*DRAFT_SCHEMA.fields, T.StructField("__corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    parsed = F.from_json(F.col(text) if isinstance(text, str) else text, schema, options)
    return F.when(parsed["title"].isNotNull() & parsed["__corrupt"].isNull(), parsed.dropFields("__corrupt"))


def has_value(code: str) -> Column:
    """True when the field holds something; an empty list holds nothing."""
    if code in LIST_FIELDS:
        return F.coalesce(F.size(F.col(code)) > 0, F.lit(False))
    return F.col(code).isNotNull()


def is_done(code: str) -> Column:
    """True when the field needs no further question: filled or skipped."""
    return has_value(code) | F.coalesce(F.array_contains("skipped", code), F.lit(False))


def open_fields() -> Column:
    """Codes without a value, skipped ones included (C20)."""
    return _codes(lambda code: ~has_value(code))


def next_open() -> Column:
    """First code still to be asked, NULL when all are done (C20)."""
    return F.get(_codes(lambda code: ~is_done(code)), F.lit(0))


def field_states(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per draft and field with its state."""
    states = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(code).alias("code"),
            has_value(code).alias("filled"),
            F.coalesce(F.array_contains("skipped", code), F.lit(False)).alias("skipped"),
            F.lit("causal" if code in K.CAUSAL_FIELDS else "functional").alias("tone"),
        )
        for position, code in enumerate(K.FIELD_ORDER)
    ]
    return df.select(*keys, F.inline(F.array(*states)))


def merge_fill(df: DataFrame, prefix: str = "fill_") -> DataFrame:
    """Copy newly read values (columns ``<prefix><field>``) into fields that are still empty."""
    merged = {}
    for code in K.FIELD_ORDER:
        new = F.col(prefix + code)
        usable = F.size(new) > 0 if code in LIST_FIELDS else new != ""
        merged[code] = F.when(has_value(code), F.col(code)).when(usable, new).otherwise(F.col(code))
    return df.withColumns(merged)


def settle_form(df: DataFrame, prefix: str = "fill_") -> DataFrame:
    """State after a whole form.

    Besides the fill columns it reads ``<prefix>written`` (codes with any text) and
    ``<prefix>unavailable`` (codes said not to exist). A written but unread field of the retry list is
    asked once more; every other empty field counts as skipped.
    """
    merged = merge_fill(df, prefix)

    def ask_again(code: str) -> Column:
        if code not in K.RETRY_FIELDS:
            return F.lit(False)
        return (
            F.array_contains(prefix + "written", code)
            & ~has_value(code)
            & ~F.array_contains("retried", code)
            & ~F.array_contains(prefix + "unavailable", code)
        )

    again = _codes(ask_again)
    return merged.withColumns(
        {
            "skipped": _set(F.array_except(open_fields(), again)),
            "retried": _set(F.array_union(F.col("retried"), again)),
        }
    )


def settle_reply(df: DataFrame, prefix: str = "fill_", asked: str = "asked") -> DataFrame:
    """State after the reply to one question, whose code is in column ``asked``.

    Fields said not to exist are skipped unless they hold a value. The asked field, if it is still
    empty, is asked once more when it is on the retry list and was not retried before, else skipped.
    """
    merged = merge_fill(df, prefix)
    gone = F.array_intersect(F.col(prefix + "unavailable"), open_fields())
    skipped = F.array_union(F.col("skipped"), gone)
    unread = F.array_contains(open_fields(), F.col(asked)) & ~F.array_contains(skipped, F.col(asked))
    again = unread & F.col(asked).isin(*K.RETRY_FIELDS) & ~F.array_contains("retried", F.col(asked))
    none = F.array().cast("array<string>")
    return merged.withColumns(
        {
            "skipped": _set(F.array_union(skipped, F.when(unread & ~again, F.array(asked)).otherwise(none))),
            "retried": _set(F.array_union(F.col("retried"), F.when(again, F.array(asked)).otherwise(none))),
        }
    )


def draft_from_row(df: DataFrame, keep_place: bool = False) -> DataFrame:
    """Rebuild a draft from a corpus row: only title and (optionally) place are known."""
    place = F.coalesce("city_name", "prefecture_name") if keep_place else F.lit(None)
    empty = {code: F.lit(None).cast("string") for code in K.FIELD_ORDER if code not in LIST_FIELDS}
    empty |= {code: F.array().cast("array<string>") for code in LIST_FIELDS}
    rebuilt = df.withColumns({**empty, "place": place.cast("string"), "retried": F.array().cast("array<string>")})
    return rebuilt.withColumn("skipped", open_fields())


def open_first(code: str, position: str, open_codes: str) -> list[Column]:
    """Sort order that puts items for an open field first and keeps their order otherwise."""
    addressed = F.coalesce(F.array_contains(open_codes, F.col(code)), F.lit(False))
    return [addressed.desc(), F.col(position).asc()]
