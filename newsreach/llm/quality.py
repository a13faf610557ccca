"""Quality classifier: supervised subword embeddings.

Learned vectors of hashed words and character n-grams are averaged over a document, and a softmax output gives
the probability of each label. Both layers are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows. As the output is linear before the softmax, scoring needs one number per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach.llm.rows import groups_of, held_out, lean, sampled
from newsreach.llm.subwords import Examples, WordTable, scatter, word_means

#: Documents the model is fitted on, at most (in expectation).
SAMPLE_ROWS = 3000
#: Steps of gradient descent, at least; a small sample is gone through more often.
LEAST_STEPS = 160
SIZES = (2, 3, 4)
BITS = 17
AGAIN = "\x04again"


def words_of(text: str) -> list[str]:
    """Words between white space. A word that repeats the one before it adds a mark, so that runs of one word show."""
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    return words + [AGAIN] * again


@dataclass
class QualityModel:
    """Fitted model: ``weights`` holds, for each bucket, its contribution to the log-odds of label 1."""

    weights: np.ndarray
    bias: float
    table: WordTable | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "table": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without words gets that of the bias alone."""
        if self.table is None:
            self.table = WordTable(self.weights[:, None], SIZES)
        logit = np.concatenate([self.table.averages(run, words_of)[:, 0] for run in groups_of(texts)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -60, 60)))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", dim: int = 8, rounds: int = 4, rate: float = 4.0, batch: int = 64, seed: int = 7) -> QualityModel:
    """Fit on every row of ``labelled`` (text, 0/1 label); the caller bounds it. NULL labels are left out.

    Without rows the score is 0.5 for every text, with rows of one label close to that label.
    """
    data = Examples(labelled, text, label, words_of, SIZES, BITS)
    rng = np.random.default_rng(seed)
    inner = (rng.random((1 << BITS, dim)) - 0.5) / dim
    outer, bias = np.zeros((dim, 2)), np.zeros(2)
    target = np.zeros((len(data), 2))
    target[np.arange(len(data)), (data.labels == "1").astype(int)] = 1
    if len(data):
        bias = np.log((target.sum(axis=0) + 1) / (len(data) + 2))
    round_steps = max(1, -(-int((data.sizes > 0).sum()) // batch))
    rounds = max(rounds, -(-LEAST_STEPS // round_steps))
    steps = rounds * round_steps
    for step, (docs, bucket, count, share) in enumerate(data.batches(batch, rounds, seed)):
        pace = rate * (1 - step / steps)
        word = np.repeat(np.arange(len(count)), count)
        vectors = word_means(inner, bucket, count)
        hidden = share @ vectors
        logits = hidden @ outer + bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        error = (target[docs] - chance) / len(docs)
        back = (share.T @ (error @ outer.T)) / count[:, None]
        outer += pace * hidden.T @ error
        bias += pace * 0.1 * error.sum(axis=0)
        scatter(inner, bucket, pace * len(docs) * back, word)
    return QualityModel((inner @ (outer[:, 1] - outer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_column(model: QualityModel, text: str = "text") -> Column:
    """Score of each row's text, 0 to 1; NULL counts as the empty text."""

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores([x or "" for x in batch]))

    return score(F.col(text))


def fit_from_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most about ``rows`` labelled documents that are not held out.

    A document with several label rows takes part once for each; a label without document is ignored.
    """
    known = sampled(labels.where(~held_out() & F.col(label).isNotNull()).select("doc_id", label), rows)
    # Repeated ids may multiply in the join, so the bound is set again behind it.
    return fit(sampled(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), rows), "text", label)


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; extra columns of ``docs`` play no part."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
