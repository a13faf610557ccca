"""Hashed word and character n-gram features, computed for many words at once in numpy.

A document is the average of its words and a word the average of its features, so every linear score of a
document is an average of per-word scores. Workers keep those in a :class:`WordTable` and do the n-gram work
once for each distinct word they meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.llm.rows import give_back, groups_of

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
OPEN, CLOSE = "\x02", "\x03"

#: Features of which rows of weights are held at once while fitting.
FEATURE_STEP = 1 << 16


def features(words: list[str], sizes: Iterable[int], bits: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket below ``2 ** bits``) of every feature of the words.

    Features are the character n-grams of the word between two border marks and, with ``whole``, the word itself.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join([f"{OPEN}{word}{CLOSE}" for word in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(chars))
    found_words, found = [], []

    def keep(index: np.ndarray, value: np.ndarray, kind: int) -> None:
        value = (value + np.uint64(kind)) * MIX
        value = (value ^ (value >> np.uint64(29))) * MIX
        found_words.append(index)
        found.append((value >> np.uint64(64 - bits)).astype(np.int64))

    with np.errstate(over="ignore"):
        running = chars.copy()
        wanted = set(sizes)
        for size in range(1, max(wanted, default=0) + 1):
            if size > 1:
                running = running[:-1] * STEP + chars[size - 1 :]
            if size in wanted and len(running):
                fits = room[: len(running)] >= size
                keep(owner[: len(running)][fits], running[fits], size)
        if whole:
            starts = ends - lengths
            powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), STEP, np.uint64))))
            place = np.arange(len(chars)) - np.repeat(starts, lengths)
            keep(np.arange(len(words)), np.add.reduceat(chars * powers[place], starts), 97)
    return np.concatenate(found_words), np.concatenate(found)


class WordTable(dict):
    """Word -> row of ``values``; rows of new words are filled by :meth:`settle`. Starts anew beyond ``limit`` words."""

    def __init__(self, weights: np.ndarray, sizes: tuple[int, ...], whole: bool = True, limit: int = 300_000):
        super().__init__()
        self.weights, self.sizes, self.whole, self.limit = weights, sizes, whole, limit
        self.bits = int(len(weights)).bit_length() - 1
        self.values = np.zeros((1024, weights.shape[1]), np.float32)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.fresh.append(word)
        return row

    def settle(self) -> None:
        """Compute the rows of the words met since the last call, some thousands at a time."""
        done = len(self) - len(self.fresh)
        if len(self) > len(self.values):
            grown = np.zeros((2 * len(self), self.weights.shape[1]), np.float32)
            grown[: len(self.values)] = self.values
            self.values = grown
        for run in groups_of(self.fresh, 20_000, 200_000):
            index, bucket = features(run, self.sizes, self.bits, self.whole)
            count = np.maximum(np.bincount(index, minlength=len(run)), 1)
            for column in range(self.weights.shape[1]):
                total = np.bincount(index, self.weights[bucket, column], len(run))
                self.values[done : done + len(run), column] = total / count
            done += len(run)
        self.fresh = []

    def averages(self, texts: list[str], words_of: Callable[[str], list[str]]) -> np.ndarray:
        """Average value row of the words of each text; zeros where a text has no word."""
        if len(self) > self.limit:
            self.clear()
        lists = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
        self.settle()
        out = np.zeros((len(texts), self.values.shape[1]))
        sizes = np.array([len(x) for x in lists])
        full = np.flatnonzero(sizes)
        if len(full):
            rows = np.concatenate([lists[i] for i in full])
            starts = np.cumsum(sizes[full]) - sizes[full]
            for column in range(out.shape[1]):
                out[full, column] = np.add.reduceat(self.values[rows, column].astype(np.float64), starts) / sizes[full]
        return out


class Examples:
    """Training rows as bags of words: the distinct words with their features, and (word, times) lists of documents.

    Spark counts the words of each document in its tasks; the driver gets counts of a bounded sample only.
    """

    def __init__(self, df: DataFrame, text: str, label: str, words_of: Callable[[str], list[str]], sizes: tuple[int, ...], bits: int, whole: bool = True):
        def count(batches):
            for batch in batches:
                rows = []
                for value, kind in zip(batch[text], batch[label]):
                    counts = Counter(words_of(value or ""))
                    rows.append((str(kind), list(counts), list(counts.values())))
                yield pd.DataFrame(rows, columns=["label", "words", "times"])

        rows = df.select(text, label).where(F.col(label).isNotNull()).mapInPandas(count, "label string, words array<string>, times array<int>").toArrow()
        self.labels = np.array(rows["label"].to_pylist(), dtype=object)
        words = pa.chunked_array([x.flatten() for x in rows["words"].chunks], pa.string()).dictionary_encode().unify_dictionaries()
        chunks = words.chunks
        self.words = chunks[0].dictionary.to_pylist() if chunks else []
        self.word = np.concatenate([x.indices.to_numpy() for x in chunks]).astype(np.int32) if chunks else np.zeros(0, np.int32)
        self.times = np.concatenate([x.flatten().to_numpy() for x in rows["times"].chunks]).astype(np.float64) if chunks else np.zeros(0)
        self.sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in rows["words"].chunks]).astype(np.int64) if chunks else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        del rows, words, chunks
        give_back()
        found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for run in groups_of(self.words, 20_000, 200_000):
            owner, bucket = features(run, sizes, bits, whole)
            found.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(run)))
        self.bucket, self.count = np.concatenate(found), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.labels)

    def batches(self, size: int, rounds: int, seed: int):
        """(documents, distinct words' features, features per word, document-word weights) of each step of SGD."""
        rng = np.random.default_rng(seed)
        usable = np.flatnonzero(self.sizes)
        for _ in range(rounds):
            order = rng.permutation(usable)
            for at in range(0, len(order), size):
                docs = order[at : at + size]
                sizes = self.sizes[docs]
                flat = spans(self.starts[docs], sizes)
                distinct, column = np.unique(self.word[flat], return_inverse=True)
                share = np.zeros((len(docs), len(distinct)))
                share[np.repeat(np.arange(len(docs)), sizes), column] = self.times[flat]
                share /= share.sum(axis=1, keepdims=True)
                yield docs, self.bucket[spans(self.first[distinct], self.count[distinct])], self.count[distinct], share


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts`` and have ``sizes`` members, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def word_means(weights: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean row of ``weights`` over the buckets of each word, ``count`` of them a word; rows are taken some thousands at a time."""
    ends = np.cumsum(count)
    out = np.empty((len(count), weights.shape[1]))
    at = 0
    while at < len(count):
        start = ends[at] - count[at]
        end = max(at + 1, int(np.searchsorted(ends, start + FEATURE_STEP, "right")))
        np.add.reduceat(weights[bucket[start : ends[end - 1]]], ends[at:end] - count[at:end] - start, axis=0, out=out[at:end])
        at = end
    return out / count[:, None]


def scatter(target: np.ndarray, rows: np.ndarray, values: np.ndarray, owner: np.ndarray) -> None:
    """Add to each of the given rows of ``target`` the row of ``values`` that ``owner`` names; rows may repeat."""
    for column in range(target.shape[1]):
        target[:, column] += np.bincount(rows, values[:, column][owner], len(target))
