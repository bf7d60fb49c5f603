"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree.

Documents are tokenized where they lie; only piece descriptions (a few longs each) move. Pieces go to randomised
groups of bounded size, and each group is packed on its own, so no task grows with the corpus.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import tidy, written

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("salt", T.LongType()),
    ]
)
_MARKS = frozenset(".,;:!?")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_encoders: dict[tuple, ChunkEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    Neither the tokenizer's normalizer nor its pre-tokenizer looks across a blank, so a text's ids are those of its
    blank-separated chunks in order. Ids of chunks are remembered, at most ``entries`` of them. Printable Latin-1
    chunks, which normalizing only lower-cases, are cut into the pre-tokenizer's runs here, and the tokenizer's model
    is asked for each new run; any other chunk is given to the whole tokenizer as it stands.
    """

    def __init__(self, path: str, entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            spelt = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            ids = self.runs[run] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        lower = chunk.lower()
        if chunk.isascii() or max(chunk) < "Ā":
            if lower.isalpha():
                return self._run(lower)
            if lower[-1] in _MARKS and lower[:-1].isalpha():
                return self._run(lower[:-1]) + self._run(lower[-1])
            if chunk.isprintable() and "<|" not in chunk:
                return b"".join(map(self._run, _SPLIT.findall(lower)))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        self.chunks.clear()
        self.runs.clear()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The texts' ids, in order; new chunks of about a million characters of text are looked up together."""
        ends = np.cumsum([len(t or "") for t in texts]) // 1_000_000
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            lists = [_words(texts[i]) for i in part]
            missing = set().union(*lists).difference(self.chunks)
            if len(self.chunks) + len(missing) > self.entries:
                self.forget()
                missing = set().union(*lists)
            chunks = self.chunks
            for chunk in missing:
                chunks[chunk] = self._chunk(chunk)
            for words in lists:
                yield b"".join([chunks[w] for w in words])


def _words(text: str | None) -> list[str]:
    """Chunks between blanks and line ends; what else is white space stays inside and is the tokenizer's to drop."""
    return text.replace("\n", " ").split(" ") if text else []


def encoder(path: str) -> ChunkEncoder:
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path)
    return _encoders[key]


def _cut(path: str, capacity: int, end_id: int):
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 36
        own = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[start * 4 : (start + capacity) * 4]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, serial))
                    serial += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.names)
        own.forget()  # the worker goes on to other tasks

    return cut


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order; items must fit a bin.

    The tournament tree's leaves are the bins' free room; each inner node holds the larger of its two children, so
    the leftmost bin with room is found from the root in logarithmic time.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for item in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        need, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            winner = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == winner:
                break
            tree[node] = winner
            node //= 2
    return bins, offsets


def _pack_group(capacity: int):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("salt", ignore_index=True)
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), capacity)
        pieces["sequence_id"] = (int(key[0]) << 32) + bins
        pieces["offset"] = offsets
        return pieces.drop(columns=["salt", "pack_group"])

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, group_pieces: int = 8192
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's for its whole text, then ``end_id``. Documents over ``capacity`` are cut at
    its multiples; their rests and the other documents stay whole. Null and empty texts are the end id alone; repeated
    rows are packed as often as they stand; null ids stay null; an empty table gives no rows. Other columns are not
    read. ``group_pieces`` is the mean size of a group.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(rows.mapInArrow(tidy(_cut(tokenizer_path, capacity, end_id)), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    schema = T.StructType([f for f in PIECES.fields if f.name != "salt"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return grouped.groupBy("pack_group").applyInPandas(_pack_group(capacity), schema)


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, their tokens and padding: to ``capacity``, but none where the length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    bare = F.bit_count(F.col("n")) == 1
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(bare, 0).otherwise(capacity - F.col("n"))).alias("padding"))
