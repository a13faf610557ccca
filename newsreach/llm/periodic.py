"""Periodic runs of words, found online by catchers over dyadic blocks.

A stream of words is read in appended pieces. On every level k, each completed block of 2**k words keeps a catcher:
it waits for its own words to come back at a distance of 2**k to 2**(k+1) - 1. An appended word completes one window
of each level; its hash is compared with that of the one block whose catcher waits at this place, so a word costs one
comparison a level (done for a whole piece at once in numpy). A block that comes back marks a repetition of that
period; it is checked word by word and extended in both directions, and later catches inside it merge into it.

A run of period q and four periods or more holds, on the level of q, a whole block and its next two copies, so it is
caught. A catch inside a run of smaller period is that run again, by the periodicity lemma. Of each level only the
last hashes are kept, twice as many as a block has words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach.llm.similar_texts import mixed

#: A run has this many words and this many periods at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words appended to a catcher at once, and words and texts whose runs are looked for in one stream.
PIECE = 1 << 18
STREAM_CHARS = 1 << 22
STREAM_TEXTS = 2048
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class SquareCatcher:
    """Runs in a stream of word numbers; ``append`` pieces of any size, then ask for ``runs``.

    ``longest`` bounds the words between two numbers that occur only once (the ends of the texts in the stream).
    """

    def __init__(self, longest: int):
        self.levels = max(longest // LEAST_PERIODS, 1).bit_length() if longest >= LEAST_WORDS else 0
        self.store = np.zeros(1024, np.int64)
        self.length = 0
        self.hashes = [np.zeros(0, np.uint64) for _ in range(self.levels)]
        self.first = [0] * self.levels
        self.open: dict[int, int] = {}
        self.last: dict[int, tuple[int, int]] = {}
        self.found: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        """Read more words; repetitions that reach the end so far go on with them."""
        old, self.length = self.length, self.length + len(words)
        if self.length > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(max(self.length, len(self.store)), np.int64)))
        self.store[old : self.length] = words
        for period, start in list(self.open.items()):
            self._close(period, start, self._end(old, period))
        below, below_first = self.store, 0
        for level in range(self.levels):
            size = 1 << level
            lower, upper = max(old - size + 1, 0), self.length - size + 1
            if upper <= lower:
                break
            known, first = self._advance(level, lower, upper, below, below_first), self.first[level]
            below, below_first = known, first
            keep = max(upper - 2 * size, first)
            self.hashes[level], self.first[level] = known[keep - first :], keep

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of the stream so far, by start and period; the period is the smallest."""
        ending = ((start, self.length, period) for period, start in self.open.items())
        smallest: dict[tuple[int, int], int] = {}
        for start, end, period in (*self.found, *ending):
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
                smallest[start, end] = min(period, smallest.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in smallest.items())

    def _advance(self, level: int, lower: int, upper: int, below: np.ndarray, below_first: int) -> np.ndarray:
        """Hash the windows that start from ``lower`` to ``upper`` out of those of the level below, and compare each with the
        block whose catcher waits for it; gives the hashes of this level that are kept so far."""
        size, half = 1 << level, 1 << level >> 1
        new = below[lower - below_first : upper - below_first].view(np.uint64) * _LEFT
        if half:
            new = new + below[lower - below_first + half : upper - below_first + half] * _RIGHT
        known, first = np.concatenate((self.hashes[level], mixed(new))), self.first[level]
        at = np.arange(max(lower, size), upper)
        block = ((at >> level) - 1) << level
        caught = np.flatnonzero(known[at - first] == known[block - first])
        if len(caught):
            self._merge(block[caught], at[caught] - block[caught], size)
        return known

    def _merge(self, block: np.ndarray, period: np.ndarray, size: int) -> None:
        """Check and extend catches (first block, period); those inside known runs are part of them already."""
        known = sorted((start, end) for start, end, p in self.found if p < size)
        known += [(start, self.length) for p, start in self.open.items() if p < size and self.length - start >= LEAST_PERIODS * p]
        if known:
            known.sort()
            starts = np.array([x[0] for x in known])
            reach = np.maximum.accumulate(np.array([x[1] for x in known]))
            before = np.searchsorted(starts, block, "right") - 1
            apart = (before < 0) | (reach[before] < block + period + size)
            block, period = block[apart], period[apart]
        for b, p in zip(block.tolist(), period.tolist()):
            start, end = self.last.get(p, (0, 0))
            if start <= b and b + p + size <= end:
                continue
            end = self._end(b + p, p)
            if end >= b + p + size:  # else only the hashes agree
                self._close(p, self._start(b, p), end)

    def _close(self, period: int, start: int, end: int) -> None:
        """Note a repetition from ``start`` to ``end``: still open at the end of the stream, or a run if long enough."""
        self.last[period] = start, end
        if end == self.length:
            self.open[period] = start
            return
        self.open.pop(period, None)
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            self.found.append((start, end, period))

    def _end(self, at: int, period: int) -> int:
        """First place from ``at`` on whose word differs from the one a period before."""
        step = 64
        while at < self.length:
            upper = min(at + step, self.length)
            differ = self.store[at:upper] != self.store[at - period : upper - period]
            place = int(differ.argmax())
            if differ[place]:
                return at + place
            at, step = upper, min(2 * step, 1 << 16)
        return at

    def _start(self, at: int, period: int) -> int:
        """Smallest place up to ``at`` from which on all words equal the one a period later."""
        step = 64
        while at > 0:
            lower = max(at - step, 0)
            differ = self.store[lower:at] != self.store[lower + period : at + period]
            place = int(differ[::-1].argmax())
            if differ[len(differ) - 1 - place]:
                return at - place
            at, step = lower, min(2 * step, 1 << 16)
        return at


class _Numbers(dict):
    """Word -> its number, in order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of a list of word lists; all go through one stream."""
    longest = max(map(len, texts), default=0)
    catcher = SquareCatcher(longest)
    if not catcher.levels:
        return [[] for _ in texts]
    numbers, starts, at = _Numbers(), [], 0
    pieces: list[np.ndarray] = []
    waiting = 0
    for place, words in enumerate(texts):
        starts.append(at)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        pieces += [ids, np.array([-1 - place])]
        at += len(words) + 1
        waiting += len(words) + 1
        if waiting >= PIECE or place + 1 == len(texts):
            stream = np.concatenate(pieces)
            for first in range(0, len(stream), PIECE):
                catcher.append(stream[first : first + PIECE])
            pieces, waiting = [], 0
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.array(starts)
    for start, length, period in catcher.runs():
        place = int(np.searchsorted(bounds, start, "right")) - 1
        found[place].append((start - starts[place], length, period))
    return found


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between space, tab and line ends; none for NULL."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def echoed(words: list[bytes], key: int | None) -> list[bytes]:
    """For one key in ten, the words from some place on replaced by repetitions of the first of them.

    A probe for tests on given texts: h is the CRC-32 of the decimal key and g = h // 10; if h % 10 is 0, each word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). No key, no change.
    """
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all of a run but its first period goes."""
    keep = None
    for start, length, period in runs:
        if keep is None:
            keep = np.ones(len(words), bool)
        keep[start + period : start + length] = False
    return words if keep is None else [words[i] for i in np.flatnonzero(keep)]


def _streams(keys: list[int | None], texts: list[str | None]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    start = chars = 0
    for place, text in enumerate(texts):
        size = len(text or "")
        if place > start and (chars + size > STREAM_CHARS or place - start >= STREAM_TEXTS):
            yield keys[start:place], texts[start:place]
            start, chars = place, 0
        chars += size
    if start < len(texts):
        yield keys[start:], texts[start:]


def periodic_runs(docs: DataFrame, echo: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period) and collapsed text of every document.

    Runs are maximal stretches of words with smallest period q, of ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words
    at least. The collapsed text is the words that no run repeats, joined by one space. Whole texts, nothing is shuffled;
    repeated rows come out as often as they occur. NULL and empty texts have no run and an empty collapsed text, a
    NULL doc_id stays NULL. Extra columns play no part; no rows give no rows. ``echo`` first applies ``echoed``.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = [x if k else None for x, k in zip(batch["doc"], batch["known"])]
            for keys, texts in _streams(known, batch["text"].tolist()):
                split = [words_of(x) for x in texts]
                if echo:
                    split = [echoed(words, key) for words, key in zip(split, keys)]
                runs = runs_of_texts(split)
                yield pd.DataFrame({
                    "doc": [key or 0 for key in keys],
                    "known": [key is not None for key in keys],
                    "runs": [[{"start": a, "length": b, "period": c} for a, b, c in x] for x in runs],
                    "collapsed": [b" ".join(collapsed(words, x)).decode("utf-8", "surrogatepass") for words, x in zip(split, runs)],
                    "best": [place_of_best(x) for x in runs],
                })

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    found = plain.mapInPandas(find, "doc long, known boolean, runs array<struct<start: long, length: long, period: long>>, collapsed string, best int")
    return found.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "runs", "collapsed", "best")


def place_of_best(runs: list[tuple[int, int, int]]) -> int:
    """Place (from 1) of the run with the greatest exponent; ties go to the smallest start, then period; 0 for no run."""
    return min(range(len(runs)), key=lambda i: (-Fraction(runs[i][1], runs[i][2]), runs[i][0], runs[i][2])) + 1 if runs else 0


def run_digests(found: DataFrame) -> DataFrame:
    """n_runs, the strongest run and digests of the runs and the collapsed text of each row of ``periodic_runs``."""
    found = found.withColumn("best", F.try_element_at("runs", F.nullif("best", F.lit(0))))

    def line(run: Column) -> Column:
        return F.concat_ws("", F.concat_ws(",", *[run[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))

    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
