"""Text columns."""

from __future__ import annotations

import re

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K

# Fixed patterns, applied in this order: tags, entities, white space.
TAG = r"<[^>]*>"
ENTITY = r"&[a-zA-Z]+;|&#[0-9]+;"
SPACES = r"\s+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def html_to_text(html: Column | str, raw: int | None = None, keep: int | None = None) -> Column:
    """Readable text of an HTML column.

    Tags become a space *before* entities do, so that words on both sides of a tag stay apart. ``raw``
    and ``keep`` limit the characters read and kept; by default the whole text is used.
    """
    source = F.coalesce(_col(html), F.lit(""))
    if raw is not None:
        source = F.left(source, F.lit(raw))
    spaced = reduce(lambda c, pattern: F.regexp_replace(c, pattern, " "), (TAG, ENTITY, SPACES), source)
    text = F.trim(spaced)
    return text if keep is None else F.left(text, F.lit(keep))


def flatten_lines(text: Column | str) -> Column:
    """Put a text on one line; NULL becomes empty."""
    return F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\n"), F.lit(" "))


def text_flags(df: DataFrame, lengths: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Replace long texts by their length and by a presence flag; NULL stays NULL."""
    added = {f"{name}_len": F.length(name) for name in lengths}
    added |= {f"has_{name}": F.col(name) != "" for name in flags}
    return df.withColumns(added)


def present_text(df: DataFrame, columns: Sequence[str] = K.TEXT_COLUMNS) -> Column:
    """Join those of ``columns`` that the table has, one per line, keeping empty lines (C4)."""
    available = [name for name in columns if name in df.columns]
    return F.concat_ws("\n", *[F.coalesce(F.col(name), F.lit("")) for name in available])


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def event_text(title: Column | str, place: Column | str, description: Column | str) -> Column:
    """Text by which an event is scored: title, place, start of the description; empties dropped."""
    head = F.left(_col(description), F.lit(K.DESCRIPTION_CHARS))
    return F.concat_ws("\n", _filled(_col(title)), _filled(_col(place)), _filled(head))


def query_text(
    title: Column | str,
    place: Column | str,
    partner: Column | str,
    novelty: Column | str,
    observation: Column | str,
    category: Column | str | None = None,
    place_name: Column | str | None = None,
) -> Column:
    """Search text of a draft; category and place name stand in for what is still open."""
    singles = [title, *(c for c in (category, place_name) if c is not None), place]
    head = [_filled(_col(c)) for c in singles]
    partners = F.filter(_col(partner), lambda name: name != "")
    return F.concat_ws(" ", *head, partners, _filled(_col(novelty)), _filled(_col(observation)))


def advised_text(plan_text: Column | str, actions: Column | str) -> Column:
    """Plan text followed by the proposed actions (C6, evaluation form)."""
    return F.concat_ws(" ", _col(plan_text), _col(actions))


def presence_flag(title: Column | str, keywords: Sequence[str] = K.PRESENCE_KEYWORDS) -> Column:
    """1.0 where the title holds one of the presence keywords."""
    return F.coalesce(_col(title), F.lit("")).rlike("|".join(map(re.escape, keywords))).cast("float")


def bare_name(name: Column | str, forms: Sequence[str] = K.LEGAL_FORMS) -> Column:
    """Company name without its legal form (C11)."""
    bare = F.regexp_replace(_col(name), "|".join(map(re.escape, forms)), "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def short_place(name: Column | str, suffixes: str = K.PLACE_SUFFIXES) -> Column:
    """Place name without its administrative suffix, unless that leaves too little."""
    name = _col(name)
    droppable = (F.length(name) > K.MIN_SHORT_LENGTH) & F.right(name, F.lit(1)).isin(*suffixes)
    return F.when(droppable, F.left(name, F.length(name) - 1)).otherwise(name)


def fit_columns(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Cut texts to the width of their target column."""
    return df.withColumns({name: F.left(F.col(name), F.lit(width)) for name, width in widths.items()})
