"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts and lexicon are folded first (case, look-alike letters, digits that stand for letters). A term matches at the
start of a word, so a stem catches its inflections. A match inside an exception phrase does not count. The sum of
weights, on its own and relative to the length, goes through a logistic curve. Terms, exceptions, weights and curve are
learned from a bounded sample of labelled rows; no word is known beforehand.

Limits of the lexicon: terms are word beginnings of 4 to 8 letters, so a longer word is known by its first eight and a
shorter word never becomes a term; of the terms that qualify the ``TERMS`` of most toxic documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach.llm.rows import held_out, sampled
from newsreach.sources.workspace import materialize

#: Documents the lexicon and the curve are fitted on, at most (in expectation).
SAMPLE_ROWS = 8000
#: Lengths of the word beginnings that may become terms, and the number of terms, at most.
LENGTHS = range(4, 9)
TERMS = 4000
#: A term needs this share of toxic documents among those that hold it, and this number of toxic documents.
PURITY = 0.9
LEAST_TOXIC = 4
#: And this share of the toxic documents.
LEAST_SHARE = 0.01
#: Pairs of neighbouring words around a term that become exceptions: held by so many clean documents, at most this many pairs.
LEAST_CLEAN = 3
EXCEPTIONS = 1000

# Letters that look alike, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "a": "аαａ@4ɑ", "b": "вβｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ3", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιｉ1ıl", "j": "јｊ", "k": "кκｋ",
    "m": "мｍ", "n": "пηｎ", "o": "оοｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ$5", "t": "тτｔ7", "u": "υｕ", "v": "νｖ", "w": "ԝｗ", "x": "хχｘ",
    "y": "уｙ", "z": "ᴢｚ",
}
FOLDING = str.maketrans({char: letter for letter, chars in LOOK_ALIKES.items() for char in chars} | {"ｌ": "i", "ӏ": "i"})


def fold(text: str) -> str:
    """Lower case, look-alikes as one letter; ``l``, ``1`` and ``i`` are one letter too, as ``1`` may stand for either."""
    return text.lower().translate(FOLDING)


class Lexicon:
    """Automaton over the folded terms and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(phrase), None))
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.holds = _Words(self)

    def matches(self, folded: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int]]]:
        """Terms and exceptions at word starts as (start, end, weight) and (start, end); of terms from one start the longest."""
        terms: dict[int, tuple[int, int, float]] = {}
        spared = []
        for last, (length, weight) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = last + 1 - length
            if start and folded[start - 1].isalnum():
                continue
            if weight is None:
                spared.append((start, last + 1))
            else:
                terms[start] = (start, last + 1, weight)
        return list(terms.values()), spared

    def measure(self, text: str) -> tuple[float, int]:
        """(sum of the weights that count, number of words) of a whole text."""
        words = text.split()
        if not any(map(self.holds.__getitem__, words)):
            return 0.0, len(words)
        terms, spared = self.matches(fold(text))
        return sum(w for a, b, w in terms if not any(x <= a and b <= y for x, y in spared)), len(words)


class _Words(dict):
    """Word -> whether any term matches in it; terms hold no white space, so texts without such a word need no scan."""

    def __init__(self, lexicon: Lexicon, limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> bool:
        found = bool(self.lexicon.matches(fold(word))[0])
        if len(self) < self.limit:
            self[word] = found
        return found


@dataclass
class ToxicityModel:
    """Weights by folded term, and the curve's coefficients for (1, sum, sum relative to length), both as logarithms."""

    weights: dict[str, float]
    curve: np.ndarray
    exceptions: tuple[str, ...] = ()
    lexicon: Lexicon | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "lexicon": None}

    def measures(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.weights, self.exceptions)
        return np.array([self.lexicon.measure(x) for x in texts]).reshape(-1, 2)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(self.measures(texts)) @ self.curve, -60, 60)))


def inputs(measures: np.ndarray) -> np.ndarray:
    total, words = measures[:, 0], measures[:, 1]
    return np.column_stack((np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))))


def beginnings(text: str) -> list[str]:
    """Distinct beginnings, of the lengths of terms, of the folded words of a text."""
    words = {word.strip(".,;:!?()\"'") for word in set(fold(text).split())}
    return list({word[:n] for word in words for n in LENGTHS if len(word) >= n})


def learn_terms(labelled: DataFrame, text: str, label: str) -> dict[str, float]:
    """Terms that mark toxic documents with their weights (smoothed log ratio of document rates), counted by Spark."""

    @F.pandas_udf("array<string>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([beginnings(x or "") for x in batch])

    pairs = labelled.select(F.col(label).cast("int").alias("toxic"), terms(F.col(text)).alias("terms"))
    whole = labelled.agg(F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)), F.count("*")).first()
    toxic_docs, clean_docs = int(whole[0]), int(whole[1] - whole[0])
    counted = pairs.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all"))
    kept = counted.where((F.col("toxic") >= max(LEAST_TOXIC, LEAST_SHARE * toxic_docs)) & (F.col("toxic") >= PURITY * F.col("all"))).orderBy(F.desc("toxic"), "term").limit(4 * TERMS).collect()
    found = {row["term"]: (row["toxic"], row["all"] - row["toxic"]) for row in kept}
    weights: dict[str, float] = {}
    for term in sorted(found, key=lambda x: (len(x), x)):
        if any(term[:n] in weights for n in range(min(LENGTHS), len(term))):
            continue
        toxic, clean = found[term]
        weight = float(np.log((toxic + 0.5) / (toxic_docs + 1)) - np.log((clean + 0.5) / (clean_docs + 1)))
        if weight > 0:
            weights[term] = weight
        if len(weights) >= TERMS:
            break
    return weights


def phrases(text: str, lexicon: Lexicon) -> list[str]:
    """Distinct folded pairs of neighbouring words of a text in which a term begins one of the words."""
    if not any(map(lexicon.holds.__getitem__, text.split())):
        return []
    words = [word.strip(".,;:!?()\"'") for word in fold(text).split()]
    marked = [bool(lexicon.matches(word)[0]) for word in words]
    return list({f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if (marked[i] or marked[i + 1]) and words[i] and words[i + 1]})


def learn_exceptions(labelled: DataFrame, weights: dict[str, float], text: str, label: str) -> tuple[str, ...]:
    """Word pairs around terms that clean documents hold and toxic ones hardly do, counted by Spark."""
    lexicon = Lexicon(weights)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [phrases(x or "", lexicon) for x in batch[text]]
            if any(found):
                yield pd.DataFrame({"phrase": [x for y in found for x in y], "toxic": np.repeat(batch[label].astype(int), list(map(len, found))).to_numpy()})

    counted = labelled.select(text, label).mapInPandas(pairs, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all"))
    clean = F.col("all") - F.col("toxic")
    kept = counted.where((clean >= LEAST_CLEAN) & (clean >= PURITY * F.col("all"))).orderBy(clean.desc(), "phrase").limit(EXCEPTIONS)
    return tuple(row["phrase"] for row in kept.collect())


def fit_curve(measures: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge keeps it finite where the classes are separable."""
    x, curve = inputs(measures), np.zeros(3)
    if not len(toxic):
        return np.array([-4.0, 1.0, 1.0])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (toxic - chance) - ridge * curve * np.array([0.1, 1, 1])
        shape = (x * (chance * (1 - chance))[:, None]).T @ x + ridge * np.diag([0.1, 1, 1])
        curve = curve + np.linalg.solve(shape, slope)
    return curve


def fit_from_labels(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most about ``rows`` labelled documents that are not held out; only counts reach the driver."""
    known = sampled(labels.where(~held_out() & F.col(label).isNotNull()).select("doc_id", label), rows)
    # Repeated ids may multiply in the join, so the bound is set again behind it.
    labelled = materialize(sampled(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), rows), "labelled")
    # Exact copies say nothing new about a term.
    once = labelled.dropDuplicates(["text", label])
    weights = learn_terms(once, "text", label)
    model = ToxicityModel(weights, np.zeros(3), learn_exceptions(once, weights, "text", label))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.measures([x or "" for x in batch["text"]])
            yield pd.DataFrame({"total": found[:, 0], "words": found[:, 1], "toxic": batch[label].astype(float)})

    rows_seen = labelled.select("text", label).mapInPandas(measure, "total double, words double, toxic double").toPandas()
    model.curve = fit_curve(rows_seen[["total", "words"]].to_numpy(), rows_seen["toxic"].to_numpy())
    return model


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """Score of each row's text, 0 to 1; NULL counts as the empty text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores([x or "" for x in batch]))

    return score(F.col(text))


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, repeated rows included; extra columns play no part."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
