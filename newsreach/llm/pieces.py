"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives a single-pass Viterbi: at each position its outputs are the pieces
that end there, and each relaxes the best score. No piece has a space mark behind another character, so the best
path of a text is that of its words one after the other; workers keep the paths of words they have met.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A character without a piece costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0

_coders: dict[int, "Coder"] = {}


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, plain enough to send to the tasks (tens of thousands of entries)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.scores = [model.get_score(i) for i in ids]
        self.normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()


class Coder(dict):
    """Word (without its first mark) -> ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 500_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit
        self.automaton, self.single = ahocorasick.Automaton(), set()
        self.by_words = True
        for i, (piece, score, normal) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal)):
            if normal:
                self.automaton.add_word(piece, (len(piece), score, i))
                self.single |= {piece} if len(piece) == 1 else set()
                self.by_words &= MARK not in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.unknown_score = min((s for s, n in zip(vocabulary.scores, vocabulary.normal) if n), default=0.0) - UNKNOWN_PENALTY
        self.spelling = [p.replace(MARK, " ").encode() if n else b"" for p, n in zip(vocabulary.pieces, vocabulary.normal)]
        for byte, i in vocabulary.byte_ids.items():
            self.spelling[i] = bytes([byte])

    def path(self, marked: str) -> list[int]:
        """Ids of the best path through the pieces."""
        size = len(marked)
        best, last = [float("-inf")] * (size + 1), [None] * (size + 1)
        best[0], done = 0.0, 0
        strange = not self.single.issuperset(marked)

        def bridge(begin: int, end: int) -> int:
            """Characters without a piece of their own are crossed as unknown."""
            for at in range(begin, end):
                if marked[at] not in self.single and best[at] + self.unknown_score > best[at + 1]:
                    best[at + 1], last[at + 1] = best[at] + self.unknown_score, (1, None)
            return max(begin, end)

        for end, (length, score, piece) in self.automaton.iter(marked):
            end += 1
            if strange:
                done = bridge(done, end)
            score += best[end - length]
            if score > best[end]:
                best[end], last[end] = score, (length, piece)
        if strange:
            bridge(done, size)
        ids, at = [], size
        while at:
            length, piece = last[at]
            if piece is not None:
                ids.append(piece)
            else:
                known = self.vocabulary.byte_ids
                ids += [known[b] for b in reversed(marked[at - 1].encode())] if known else [self.vocabulary.unknown]
            at -= length
        return ids[::-1]

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.path(MARK + word)).tobytes()
        if len(self) < self.limit:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. A mark stands for each space and one more before the text; the empty text has none."""
        if not text:
            return b""
        if not self.by_words:
            words = [text.replace(" ", MARK)]
        elif "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            words = [chunk[1:] for chunk in CHUNK.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        return b"".join(map(self.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that make no character become U+FFFD, unknown and control ids nothing."""
        text = b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def coder(vocabulary) -> Coder:
    """The worker's coder for a broadcast vocabulary, built once."""
    if vocabulary.id not in _coders:
        _coders[vocabulary.id] = Coder(vocabulary.value)
    return _coders[vocabulary.id]


class Shared:
    """A broadcast vocabulary with a number to tell it from others."""

    def __init__(self, docs: DataFrame, path: str):
        self.value_of = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
        self.id = hash(path)

    @property
    def value(self) -> Vocabulary:
        return self.value_of.value


def encode_column(docs: DataFrame, model: str, text: str = "text") -> Column:
    """Ids of each row's text as an array; NULL counts as the empty text."""
    shared = Shared(docs, model)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.frombuffer(coder(shared).encode(x or ""), "<u4").astype("int32") for x in batch])

    return encode(F.col(text))


def decode_column(docs: DataFrame, model: str, ids: str = "ids") -> Column:
    """Text of each row's ids; NULL gives the empty text."""
    shared = Shared(docs, model)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["" if x is None else coder(shared).decode(np.asarray(x)) for x in batch])

    return decode(F.col(ids))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces among them), ids_crc32, round_trip of every whole text.

    ids_crc32 is over the ids as unsigned little-endian 32-bit numbers. round_trip says that decoding gives the text
    back; only a text with the space mark U+2581 itself comes back with spaces instead. NULL and empty texts have
    no token and come back empty. Repeated rows come out as often as they occur; extra columns play no part.
    """
    shared = Shared(docs, model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(shared)
        is_byte = np.zeros(len(own.spelling), bool)
        is_byte[list(own.vocabulary.byte_ids.values())] = True
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                text = text if isinstance(text, str) else ""
                raw = own.encode(text)
                ids = np.frombuffer(raw, "<u4")
                rows.append((None if pd.isna(key) else int(key), len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), own.decode(ids) == text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip"]).astype({"doc_id": "Int64"})

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInPandas(work, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean")
