"""License scan by a positional rare-token index. DataFrame functions only.

Every template is a run of words with a mandatory key phrase inside it. The words of all templates are ranked by
their document frequency in the scanned corpus. A file's licence words, rarest first, select the templates whose
rarest key word they hold; the postings (places) of the two rarest key words, moved by their place in the phrase,
are intersected, and at each common start the whole key phrase is verified. The other words of a template only add
to its score. A place of a key phrase contains all its words, so none is missed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word: ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's wording: ``key`` must stand somewhere in it, word by word; ``base`` marks a contract phrase."""

    label: str
    key: str
    text: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return (self.text or self.key).split()

    @property
    def shift(self) -> int:
        """Place of the key phrase in the template."""
        key, words = self.key.split(), self.words
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# Phrases of the base labels and of public licence texts.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit-grant", "permission is hereby granted free of charge",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text, A to Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAK), "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({word for template in templates for word in template.key.split()})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Number of documents that hold each key word, over all documents; as many numbers as key words reach the driver."""
    known = vocabulary(templates)
    found = F.array_intersect(F.array(*map(F.lit, known)), F.split(F.lower(F.col(text)), BREAK))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {word: 0 for word in known} | {row["word"]: row["count"] for row in counted}


def starts(template: Template, ranked: list[str]) -> Column:
    """Ascending starts (word places from 0) of the template's key phrase; ``ranked`` has the key words, rarest first."""
    key = template.key.split()
    rare = sorted(set(key), key=ranked.index)[:2]

    def moved(word: str) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i) == word)
        return F.transform(places, lambda i: i - key.index(word))

    common = moved(rare[0])
    for word in rare[1:]:
        common = F.array_intersect(common, moved(word))
    if len(key) != len(set(key)):
        # A repeated word stands at several places of the phrase: start from the rarest word that does not.
        single = sorted((w for w in set(key) if key.count(w) == 1), key=ranked.index)
        common = moved(single[0]) if single else F.sequence(F.lit(0), F.size("words") - 1)
    phrase = F.array(*map(F.lit, key))
    verified = F.filter(common, lambda s: (s >= 0) & (s + len(key) <= F.size("words")) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(key)) == phrase))
    nothing = F.array().cast("array<int>")
    return F.when(F.array_contains("rare", rare[0]) if rare else F.lit(True), verified).otherwise(nothing)


def agreement(template: Template, found: Column) -> Column:
    """Largest share of the template's words that stand at their place relative to a verified key phrase."""
    words = template.words

    def share(start: Column) -> Column:
        hits = None
        for place, word in enumerate(words):
            at = start + (place - template.shift)
            hit = F.when((at >= 0) & (F.get("words", at) == word), 1.0).otherwise(0.0)
            hits = hit if hits is None else hits + hit
        return hits / len(words)

    if words == template.key.split():
        return F.when(F.size(found) > 0, 1.0).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(found, share)), F.lit(0.0))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row, and each label's places.

    Places are word numbers from 0. NULL and empty texts have no words, no labels and score 0. Labels are distinct,
    sorted and joined by commas; the score is the best agreement of a found template. Repeated rows come out as
    often as they occur; extra columns play no part. Rows stay where they are: nothing is shuffled but word counts.
    """
    counts = document_frequencies(docs, templates)
    ranked = sorted(counts, key=lambda word: (counts[word], word))
    anchors = sorted({min(set(t.key.split()), key=ranked.index) for t in templates}, key=ranked.index)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Files without any template's rarest word need no look at their postings; the letters may have either case.
    any_anchor = F.regexp_like(text, F.lit("(?i)(" + "|".join(map(re.escape, anchors)) + ")"))
    total = F.size(F.array_remove(F.split(text, BREAK), ""))
    base = docs.select(F.col("doc_id"), total.cast("long").alias("n_words"), F.when(any_anchor, words_of(text)).alias("words"))
    base = base.withColumn("rare", F.array_intersect(F.array(*map(F.lit, ranked)), F.coalesce("words", F.array().cast("array<string>"))))
    names = [f"t{i}" for i in range(len(templates))]
    found = base.withColumns({name: starts(template, ranked) for name, template in zip(names, templates)})
    scored = found.withColumns({f"{name}_share": agreement(template, F.col(name)) for name, template in zip(names, templates)})

    def labels(only_base: bool) -> Column:
        marks = [F.when(F.size(n) > 0, F.lit(t.label)) for n, t in zip(names, templates) if t.base or not only_base]
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*marks)))))

    own = F.flatten(F.array(*[F.col(n) for n, t in zip(names, templates) if t.base]))
    return scored.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"),
        F.array_min(own).cast("long").alias("first_word"), F.array_max(own).cast("long").alias("last_word"),
        labels(True).alias("base_labels"), labels(False).alias("labels"),
        F.greatest(*[f"{n}_share" for n in names]).cast("double").alias("score"),
        F.map_from_arrays(F.array(*[F.lit(t.key) for t in templates]), F.array(*names)).alias("places"),
    )
