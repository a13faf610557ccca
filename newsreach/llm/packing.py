"""Harmonic packing of token sequences.

Lengths are divided into reciprocal-capacity classes: class ``k`` holds lengths from above ``capacity / (k + 1)`` to
``capacity / k``, and every sequence of the class takes exactly ``k`` pieces. Since documents may be cut, a document
is first cut into full sequences, and its rest into the largest exact reciprocals that fit, so that nearly every
piece fills its share of a class exactly. Each worker fills its own sequences and needs nothing from the others;
what is left of its classes in the end goes into shared sequences, largest piece first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CAPACITY = 4096
#: A rest of so many tokens or fewer stays one piece.
SHORT = 64
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[int, "WordEncoder"] = {}


def cut(tokens: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > short:
        size = capacity // -(-capacity // rest)
        pieces.append(size)
        rest -= size
    return pieces + [rest] * (rest > 0)


#: A word of plain letters with punctuation behind it: the tokenizers meant here lower-case it and part it there.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
PROBES = ("the", "The", "ÉTÉ", "straße", "don.", "end!!", "a,", "Ouwhea", "x")


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level tokenizers write for it: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """White-space word -> its ids as little-endian 32-bit bytes, by a tokenizer whose tokens never hold white space.

    Plain words skip normalisation and pre-tokenisation and go straight to the tokenizer's merges, if that gives
    the library's own ids for probe words.
    """

    def __init__(self, description: str, limit: int = 500_000):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_str(description), limit
        self.letters = str.maketrans(byte_letters())
        self.direct = True
        self.direct = all(self[word] == self.whole(word) for word in PROBES)
        self.clear()

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word) if self.direct else None
        if plain is None:
            found = self.whole(word)
        else:
            head, tail = plain.groups()
            low = head.lower()
            if tail or low != head:
                found = self[low] + (self.whole(tail) if tail else b"")
            else:
                spelled = low.encode().decode("latin-1").translate(self.letters)
                found = array("I", [token.id for token in self.tokenizer.model.tokenize(spelled)]).tobytes()
        if len(self) < self.limit:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


class Packer:
    """Sequences of one worker: open ones by class, and what they still lack."""

    def __init__(self, worker: int, capacity: int):
        self.next, self.capacity, self.open = worker << 32, capacity, {}
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        count = self.capacity // piece[2]
        pieces = self.open.setdefault(count, [])
        pieces.append(piece)
        if len(pieces) == count:
            self.close(self.open.pop(count))

    def finish(self) -> None:
        """Pieces of unfinished classes, fewer than ``k`` of each class ``k``, first fit in order of decreasing length."""
        rest = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        bins: list[list] = []
        first: dict[int, int] = {}
        for piece in rest:
            at = first.get(piece[2], 0)
            while at < len(bins) and bins[at][0] < piece[2]:
                at += 1
            if at == len(bins):
                bins.append([self.capacity, []])
            bins[at][0] -= piece[2]
            bins[at][1].append(piece)
            first[piece[2]] = at
        for _, pieces in bins:
            self.close(pieces)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: where it starts, its length, the CRC-32 of its ids, its sequence and its place there.

    ``tokenizer`` is the path of a tokenizer description that drops white space, read once by the driver and sent to
    the tasks (a few MB, whatever the corpus). Each document ends with id 2, so an empty or NULL text is one piece of
    one token. Repeated rows are packed as often as they occur. A NULL doc_id stays NULL. No rows give no pieces.
    Extra columns play no part. Nothing is shuffled: sequences of a worker hold documents of its own partition, and
    a repeated task gives the same sequences.
    """
    with open(tokenizer, encoding="utf-8") as file:
        description = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(hash(description.value)) or WordEncoder(description.value)
        _encoders[hash(description.value)] = encoder
        packer = Packer(TaskContext.get().partitionId(), capacity)

        def out() -> pd.DataFrame:
            rows, packer.done = packer.done, []
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return frame.astype({"doc_id": "Int64"})

        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            keys = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for key, text in zip(keys, texts):
                ids = encoder.encode(text) + end
                tokens, start, view = len(ids) // 4, 0, memoryview(ids)
                for length in cut(tokens, capacity):
                    packer.add((key, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), tokens))
                    start += length
            yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, PIECES)
