"""Near duplicates by SimHash, compared at the anchor points of a covering code.

A fingerprint has 64 bits: a bit is set if it is set in over half the hashes of the text's 3-word shingles. Anchors
are the codewords of two [23, 12] Golay codes side by side, on the first 46 bits. The code is perfect: every block
lies within 3 bits of exactly one codeword, so the anchors cover all fingerprints with a radius of 3 in each block.
A fingerprint is at home at its nearest anchor and is copied to every anchor within the covering radius plus the
threshold of 2, the surplus of both blocks together. Of two fingerprints that differ in at most 2 bits, each is
therefore found at the other's home; they are compared there, on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach.llm.components import connected_components
from newsreach.sources.workspace import materialize

THRESHOLD = 2
WIDTH = 23
RADIUS = 3
#: Generator of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: An anchor that is home to more fingerprints than both of these is dealt to several tasks.
HOT_HOMES = 4096
HOT_ANCHORS = 1000
SEED = 42


def words_of(text: str) -> list[bytes]:
    """UTF-8 words between space, tab and line ends, with A to Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of 3-word shingles; a text without words has 0, one with fewer than 3 a single shingle."""
    words = words_of(text or "")
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), SEED)
    votes = np.zeros(64, np.int64)
    total = len(words) - 2
    for at in range(0, total, 1 << 16):
        run = words[at : at + (1 << 16) + 2]
        hashes = np.fromiter((digest(b"%b %b %b" % x, SEED) for x in zip(run, run[1:], run[2:])), np.uint64, len(run) - 2)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text: str = "text") -> Column:
    """Fingerprint of each row's text as a signed long; NULL counts as the empty text."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x) for x in batch], np.uint64).view(np.int64))

    return compute(F.col(text))


def syndromes() -> np.ndarray:
    """Remainder by the generator of every 23-bit word, from those of single bits."""
    single = []
    for bit in range(WIDTH):
        value = 1 << bit
        for high in range(WIDTH - 1, 10, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - 11)
        single.append(value)
    table = np.zeros(1 << WIDTH, np.uint16)
    for bit, value in enumerate(single):
        table[1 << bit : 2 << bit] = table[: 1 << bit] ^ value
    return table


class Anchors:
    """For a block of 23 bits: its codeword, and those 1 and 2 bits beyond the covering radius."""

    def __init__(self) -> None:
        self.table = syndromes()
        self.errors, self.first, self.count = [], [], []
        for weights in (range(RADIUS + 1), (RADIUS + 1,), (RADIUS + 2,)):
            words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(WIDTH), w)], np.int64)
            coset = self.table[words]
            order = np.argsort(coset, kind="stable")
            count = np.bincount(coset, minlength=2048)
            self.errors.append(words[order])
            self.count.append(count)
            self.first.append(np.cumsum(count) - count)

    def near(self, blocks: np.ndarray, surplus: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``blocks``, codeword) of the codewords at distance radius + surplus (or within the radius, for 0)."""
        coset = self.table[blocks]
        count, first = self.count[surplus][coset], self.first[surplus][coset]
        index = np.repeat(np.arange(len(blocks)), count)
        ends = np.cumsum(count)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)
        return index, blocks[index] ^ self.errors[surplus][place]


_anchors: list[Anchors] = []


def anchors() -> Anchors:
    """The tables above, built once per Python worker."""
    if not _anchors:
        _anchors.append(Anchors())
    return _anchors[0]


def entries(fingerprints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, index of the fingerprint, at home) of every anchor that a fingerprint is copied to."""
    code, mask = anchors(), (1 << WIDTH) - 1
    values = fingerprints.view(np.uint64)
    left, right = (values & np.uint64(mask)).astype(np.int64), ((values >> np.uint64(WIDTH)) & np.uint64(mask)).astype(np.int64)
    for first in range(THRESHOLD + 1):
        index, word = code.near(left, first)
        for second in range(THRESHOLD + 1 - first):
            inner, other = code.near(right[index], second)
            yield word[inner] | other << WIDTH, index[inner], first == second == 0


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what ``a`` - ``b`` hold together, one per node: to the smallest node of its component."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def compare(anchor: np.ndarray, value: np.ndarray, homes_at: np.ndarray, homes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links between copies and the homes of the same anchor (``homes_at`` ascending), in blocks of bounded size."""
    low, high = np.searchsorted(homes_at, anchor, "left"), np.searchsorted(homes_at, anchor, "right")
    met = np.flatnonzero(high > low)
    done = 0
    while done < len(met):
        sums = np.cumsum((high - low)[met[done : done + most]])
        step = max(1, int(np.searchsorted(sums, most, "right")))
        rows = met[done : done + step]
        done += step
        for start in range(0, int((high - low)[rows].max()), most):
            size = np.clip((high - low)[rows] - start, 0, most)
            ends = np.cumsum(size)
            mine = np.repeat(value[rows], size)
            theirs = homes[np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(low[rows] + start, size)]
            near = (np.bitwise_count(mine.view(np.uint64) ^ theirs.view(np.uint64)) <= THRESHOLD) & (mine != theirs)
            if near.any():
                yield spanning(mine[near], theirs[near])


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) links that connect exactly the components of "differ in 1 or 2 bits" among distinct ``fingerprint`` values.

    Equal fingerprints are one here, so copies cost nothing. Within an anchor every copy is compared with every
    home, in blocks; instead of all near pairs a spanning forest of each block leaves the task. An anchor that is
    home to very many fingerprints has its homes dealt over several tasks, and the copies go to each of them.
    """
    distinct = fingerprints.select("fingerprint").distinct()

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fingerprint"].to_numpy(np.int64)
            for at in range(0, len(values), 5000):
                run = values[at : at + 5000]
                for anchor, index, home in entries(run):
                    yield pd.DataFrame({"anchor": anchor, "probe": not home, "fingerprint": run[index]})

    copies = distinct.mapInPandas(copy, "anchor long, probe boolean, fingerprint long")

    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for anchor, index, at_home in entries(batch.to_numpy(np.int64)):
                if at_home:
                    out[index] = anchor
            yield pd.Series(out)

    homes = distinct.select(F.pandas_udf(home, "long")("fingerprint").alias("anchor"))
    counted = materialize(homes.groupBy("anchor").count(), "homes")
    total = counted.agg(F.sum("count")).first()[0] or 0
    most = max(HOT_HOMES, total // HOT_ANCHORS)
    # More than total / HOT_ANCHORS each: fewer than HOT_ANCHORS rows, whatever the corpus.
    hot = counted.where(F.col("count") > most).select("anchor", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    dealt = copies.join(F.broadcast(hot), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    # A fingerprint is also a copy at its own home, so a home takes part twice: as home and as copy.
    at_home = dealt.where(~F.col("probe")).select("anchor", own.alias("part"), F.lit(False).alias("probe"), "fingerprint")
    probes = dealt.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("probe"), "fingerprint")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        homes_at, homes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor = batch["anchor"].to_numpy(np.int64) * 65536 + batch["part"].to_numpy(np.int64)
            probe, value = batch["probe"].to_numpy(bool), batch["fingerprint"].to_numpy(np.int64)
            going_on = homes_at == anchor[0] if len(anchor) else np.zeros(len(homes_at), bool)
            homes_at = np.concatenate((homes_at[going_on], anchor[~probe]))
            homes = np.concatenate((homes[going_on], value[~probe]))
            for a, b in compare(anchor[probe], value[probe], homes_at, homes):
                yield pd.DataFrame({"a": a, "b": b})
            if len(anchor):
                last = homes_at == anchor[-1]
                homes_at, homes = homes_at[last], homes[last]

    return (
        probes.union(at_home).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "probe")
        .mapInPandas(meet, "a long, b long").where("a <> b")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    component_id is the smallest doc_id that links of at most 2 differing bits lead to, the document itself
    included. NULL and empty texts have fingerprint 0 and are linked like any other; repeated rows come out as often
    as they occur; a NULL doc_id takes part but names no component (NULL if the whole component has none). Extra
    columns play no part. No rows give no rows.
    """
    marked = materialize(docs.select(F.col("doc_id").cast("long"), fingerprint_column().alias("fingerprint")), "fingerprints")
    smallest = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")), "smallest")
    found = connected_components(links(smallest))
    linked = smallest.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint")
    names = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    # Fingerprints without a link are not in any edge and name their component themselves.
    named = materialize(
        smallest.join(linked.join(names, "root").select("fingerprint", "component_id"), "fingerprint", "left")
        .select("fingerprint", F.coalesce("component_id", "doc").alias("component_id")), "named")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
