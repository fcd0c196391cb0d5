"""Encoding texts with a public byte-level BPE vocabulary, and decoding them."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that cuts a text into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers at most.
REMEMBERED = 200_000


class Bpe:
    """A byte-level BPE vocabulary: rank of a symbol = its id, lower ranks merge first."""

    def __init__(self, lines: bytes, pattern: str = PATTERN) -> None:
        self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines.splitlines())}
        self.words = {rank: word for word, rank in self.ranks.items()}
        self.cut = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        The symbols form a doubly linked list over the piece's byte positions; a queue
        holds the merges that neighbours offer, lowest rank and leftmost first. A merge
        that comes up after one of its symbols has changed is stale and skipped.
        """
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, left, middle, end = heapq.heappop(queue)
            if after[left] != middle or middle >= n or after[middle] != end:
                continue
            after[left] = end
            after[middle] = -1
            if end < n:
                before[end] = left
                if (rank := ranks.get(piece[left : after[end]])) is not None:
                    heapq.heappush(queue, (rank, left, end, after[end]))
            if left:
                start = before[left]
                if (rank := ranks.get(piece[start:end])) is not None:
                    heapq.heappush(queue, (rank, start, left, end))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.cut.findall(text):
            found = known.get(piece)
            if found is None:
                found = self.merge(piece.encode())
                if len(piece) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", errors="replace")


_loaded: dict[int, Bpe] = {}


def _vocabulary(lines: bytes) -> Bpe:
    """One per worker and vocabulary."""
    key = hash(lines)
    if key not in _loaded:
        _loaded[key] = Bpe(lines)
    return _loaded[key]


def _read(df: DataFrame, vocabulary: str):
    """The vocabulary file, sent from the driver: its size is fixed and the workers need no such file."""
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_corpus(documents: DataFrame, *, id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:  # noqa: A002
    """The token ids of every text, without special tokens: (id, ids).

    Every row gives a row, whole texts only, no shuffle. Strings that look like special
    tokens are ordinary text. Defined cases: a null or empty text has an empty list; a
    null or repeated id is kept as it is; extra columns are ignored.
    """
    lines = _read(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(lines.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                coded = [bpe.encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = [0]
                for ids in coded:
                    offsets.append(offsets[-1] + len(ids))
                values = pa.array(list(chain.from_iterable(coded)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [id, "ids"])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, *, id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:  # noqa: A002
    """The number of tokens of every text: (id, n_tokens); cases as for :func:`encode_corpus`."""
    return encode_corpus(documents, id=id, text=text, vocabulary=vocabulary).select(id, F.size("ids").alias("n_tokens"))


def decode_corpus(encoded: DataFrame, *, id: str = "doc_id", ids: str = "ids", vocabulary: str = BYTE_BPE_50K) -> DataFrame:  # noqa: A002
    """The texts of token ids: (id, text). An empty or null list is the empty text; unknown ids raise."""
    lines = _read(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(lines.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], [id, "text"])

    kind = encoded.schema[id].dataType.simpleString()
    return encoded.select(F.col(id), F.col(ids)).mapInArrow(run, f"`{id}` {kind}, text string")
