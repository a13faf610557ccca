"""Language ID by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit, a logistic regression on hashed character n-grams,
predicts that bit; decoding weighs the logistic loss of each bit by the bit's training accuracy and chooses the
nearest codeword. A small gap to the next codeword flags the document as ambiguous. A loss against the nearest codeword
that hardly any text of a known language has says that the text is in none of them (``loss_limits``, ``accepted``).
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
from newsreach.operators.ranks import quantiles
from newsreach.sources.workspace import materialize

#: Documents the classifiers are fitted on, at most (in expectation).
SAMPLE_ROWS = 2000
#: Steps of gradient descent, at least; a small sample is gone through more often.
LEAST_STEPS = 160
SIZES = (1, 2, 3)
BITS = 16
UNKNOWN = "und"
#: Normalised gap between the nearest two codewords below which a document is ambiguous.
GAP = 0.1
#: Share of the labelled documents within the limits of the loss.
WITHIN = 0.998
#: Different losses that one task puts in order; more are dealt by range.
WINDOW_ROWS = 10_000
#: Texts with fewer words have a limit of their own, as their losses scatter more.
SHORT = 20


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 per class.

    Up to seven classes take the exhaustive code (every split of the classes once); more take the random code with
    the largest smallest distance out of many draws, with ten bits per doubling of the number of classes.
    """
    if classes <= 7:
        columns = np.arange(1, 1 << max(classes - 1, 0))
        return np.array([[1] * len(columns)] + [list(1 - 2 * ((columns >> i) & 1)) for i in range(classes - 1)])[:classes]
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(classes)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice((-1, 1), (classes, width))
        product = code @ code.T - 2 * width * np.eye(classes, dtype=int)
        least = (width - product.max()) // 2
        if least > distance and (np.abs(code.sum(axis=0)) < classes).all():
            best, distance = code, least
    return best


@dataclass
class LanguageModel:
    """Fitted bit classifiers; ``weights`` has a row per bucket and a column per bit."""

    classes: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    table: WordTable | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, gap, least loss) of rows of bit margins: weighted logistic loss against each codeword, least first."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = chance.max(axis=1) / chance.sum(axis=1)
        ranked = np.take_along_axis(loss, order, axis=1)
        gap = (ranked[:, 1] - ranked[:, 0]) / np.maximum(ranked[:, 1] + ranked[:, 0], 1e-12) if len(self.classes) > 1 else np.ones(len(loss))
        return order[:, 0], score, gap, ranked[:, 0]

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, ambiguous and loss of each text; a NULL text or one without letters is ``und`` with score 0, without loss."""
        spelled = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts], dtype=bool)
        out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": True, "loss": np.nan}, index=range(len(texts)))
        if not self.classes or not spelled.any():
            return out
        if self.table is None:
            self.table = WordTable(self.weights, SIZES, whole=False)
        known = [x for x, letters in zip(texts, spelled) if letters]
        margins = np.concatenate([self.table.averages(run, words_of) for run in groups_of(known)]) + self.bias
        chosen, score, gap, loss = self.decode(margins)
        out.loc[spelled, "lang_pred"] = np.array(self.classes, dtype=object)[chosen]
        out.loc[spelled, "score"] = score
        out.loc[spelled, "ambiguous"] = gap < GAP
        out.loc[spelled, "loss"] = loss
        return out


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", rounds: int = 3, rate: float = 40.0, batch: int = 64, seed: int = 5) -> LanguageModel:
    """Fit on every row of ``labelled``; the caller bounds it. Rows without label or words teach nothing."""
    data = Examples(labelled, text, label, words_of, SIZES, BITS, whole=False)
    classes = sorted(set(data.labels))
    code = codewords(len(classes)) if classes else np.zeros((0, 0))
    width = code.shape[1] if len(classes) > 1 else 0
    weights, bias, hits = np.zeros((1 << BITS, width)), np.zeros(width), np.zeros(width)
    place = {name: i for i, name in enumerate(classes)}
    target = code[[place[x] for x in data.labels]] if len(data) else np.zeros((0, width))
    round_steps = max(1, -(-int((data.sizes > 0).sum()) // batch))
    rounds, seen = max(rounds, -(-LEAST_STEPS // round_steps)), 0
    steps = rounds * round_steps
    for step, (docs, bucket, count, share) in enumerate(data.batches(batch, rounds, seed) if width else ()):
        pace = rate * (1 - step / steps)
        word = np.repeat(np.arange(len(count)), count)
        values = word_means(weights, bucket, count)
        margins = share @ values + bias
        wanted = target[docs]
        if step >= steps * (rounds - 1) // rounds:
            hits, seen = hits + (margins * wanted > 0).sum(axis=0), seen + len(docs)
        error = wanted / (1 + np.exp(np.clip(margins * wanted, -50, 50))) / len(docs)
        back = (share.T @ error) / count[:, None]
        bias += 0.1 * pace * error.sum(axis=0)
        scatter(weights, bucket, pace * len(docs) * back, word)
    right = np.clip((hits + 1) / (seen + 2), 0.5, 0.999)
    trust = np.log(right / (1 - right)) + 1e-3
    return LanguageModel(classes, code, weights.astype(np.float32), bias, trust / trust.sum() if width else trust)


def fit_from_documents(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most about ``rows`` documents with a language that are not held out."""
    return fit(sampled(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), rows))


def predict_column(model: LanguageModel, text: str = "text") -> Column:
    """Struct of lang_pred, score, ambiguous and loss (NaN for ``und``) for each row's text."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, loss double")
    @lean
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model.predict([x if isinstance(x, str) else None for x in batch])

    return predict(F.col(text))


def _short(text: str) -> Column:
    return F.size(F.split(F.substring(F.col(text), 1, 64 * SHORT), r"\s+", SHORT)) < SHORT


def with_loss(model: LanguageModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``__loss`` (NULL for ``und``) and ``__short``, stored, so that limits and decision rest on one decoding of every text."""
    loss = predict_column(model, text)["loss"].alias("__loss")
    found = materialize(docs.select("*", loss, _short(text).alias("__short")), "language-losses")
    return found.withColumn("__loss", F.when(~F.isnan("__loss"), F.col("__loss")))


def loss_limits(found: DataFrame) -> tuple[float, float]:
    """Losses that ``WITHIN`` of the documents with a language stay within, (long, short) texts; ``found`` is from ``with_loss``.

    Measured on every such document that is not held out. Without a text of one kind its limit is that of the other,
    without any there is none.
    """
    known = found.where(~held_out() & F.col("lang").isNotNull() & F.col("__loss").isNotNull())
    rows = quantiles(known, ["__short"], "__loss", {"limit": WITHIN}, hot_rows=WINDOW_ROWS).collect()
    limits = {r["__short"]: r["limit"] for r in rows}
    most = max(limits.values(), default=float("inf"))
    return limits.get(False, most), max(limits.get(True, most), limits.get(False, most))


def accepted(limits: tuple[float, float]) -> Column:
    """Whether a row of ``with_loss`` has letters and its loss is within the limit of its length."""
    within = F.col("__loss") <= F.when(F.col("__short"), F.lit(limits[1])).otherwise(F.lit(limits[0]))
    return F.coalesce(within, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document; extra columns play no part."""
    found = docs.select("doc_id", held_out().alias("held_out"), predict_column(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")
