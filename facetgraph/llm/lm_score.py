"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A unit x seen c times is held as the members (x, 1) to (x, q), q = 1 + floor(log_base c); a lookup probes (x, 1),
(x, 2), ... until one is missing. Counting moves no text: each block of documents sends its distinct hashed n-grams,
packed, to segments of the hash space; each segment counts its own and writes its own part of the filter to the shared
folder. Every worker has all parts: where the folder is a mounted one the workers of a machine map the same pages,
elsewhere each reads parts as it needs them and keeps some.

With q(h, w) the quantised count of a pair, S(h) its sum over w, u(w) the unigram share and x the false pairs that a
history is expected to have, p(w | h) = (q(h, w) + m u(w)) / (S(h) + m + x): it sums to 1 over the vocabulary. S is in the
filter too, as binary digits of its ratio to the history's own quantised count. m comes from all training pairs.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.llm.common import give_back, new_folder, remove, tidy, written

BASE = 2**0.5
END, BEGIN = b" end", b" begin"  # no word has a blank
BLOCK_BYTES = 6_000_000
LOW = np.uint64(28)
#: Bits asked for the first level of a pair, of a word, for later levels and for the digits of a normaliser. A history has
#: some of the vocabulary as false pairs, and rare histories have few true ones, so the first takes the most.
PAIR_PROBES, WORD_PROBES, MORE_PROBES, DIGIT_PROBES = 25, 15, 10, 15
#: Bits of one cell; the probes are multiples of it.
GROUP = 5
#: Binary digits of a normaliser; their members have the numbers from DIGIT_NUMBER on, beyond all levels.
DIGITS, DIGIT_NUMBER = 8, 1000
#: Counts up to this level are exact: 1, 2 and 3.
EXACT_LEVEL = 4
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, score double"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E6D62D06F6A9A9B)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """36 bits of the hash a of the history, then 28 bits of both."""
    both = mix(a * np.uint64(3) + mix(b + np.uint64(0x51_7C_C1_B7_27_22_0A_95)))
    return ((a >> LOW) << LOW) | (both >> (np.uint64(64) - LOW))


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_base count); 0 for 0."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


@functools.cache
def two_bits() -> np.ndarray:
    """Two bits of 64, by the 12 bits of their places."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (one[:, None] | one).reshape(-1)


@functools.cache
def counts_of_levels(top: int = 130) -> np.ndarray:
    """The mean of the counts that a level stands for; 0 for level 0."""
    out = [0.0]
    for q in range(1, top):
        low, high = int(np.ceil(BASE ** (q - 1) - 1e-9)), int(np.ceil(BASE**q - 1e-9)) - 1
        out.append((low + max(low, high)) / 2)
    return np.asarray(out)


class FilterPart:
    """One part of the filter, as 64-bit cells. A member of ``probes`` bits has GROUP of them in each of its cells.

    A key that isn't a member is found with a chance of some 2 ** -probes; ``false`` has it for PAIR_PROBES, as measured.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def places(keys: np.ndarray, number: np.ndarray | int, turn: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and numbers whose lower bits, 6 by 6, say which bits of them."""
        x = mix(keys + np.asarray(number).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(turn * 0x9FB21C651E98DF25 % 2**64))
        return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32), x

    @classmethod
    def build(cls, members: list[tuple[np.ndarray, np.ndarray, int]]) -> FilterPart:
        """Of (keys, numbers, probes)."""
        size = max(16, int(np.ceil(sum(len(k) * probes for k, _, probes in members) / np.log(2) / 64)))
        on = np.zeros((size, 64), dtype=bool)
        for keys, numbers, probes in members:
            for at in range(0, len(keys), 500_000):
                for turn in range(probes // GROUP):
                    cell, x = cls.places(keys[at : at + 500_000], numbers[at : at + 500_000], turn, size)
                    for i in range(GROUP):
                        on[cell, (x >> np.uint64(6 * i)) & np.uint64(63)] = True
        part = cls(np.packbits(on.reshape(-1), bitorder="little").view(np.uint64))
        part.false = float((on.mean(axis=1) ** GROUP).mean() ** (PAIR_PROBES // GROUP))
        return part

    def has(self, keys: np.ndarray, number: int, probes: int) -> np.ndarray:
        """Whether (key, number) is a member, for each key."""
        out, alive, two = np.zeros(len(keys), dtype=bool), np.arange(len(keys)), two_bits()
        for turn in range(probes // GROUP):
            cell, x = self.places(keys, number, turn, len(self.cells))
            mask = two[x & np.uint64(4095)] | two[(x >> np.uint64(12)) & np.uint64(4095)] | (np.uint64(1) << ((x >> np.uint64(24)) & np.uint64(63)))
            hit = self.cells[cell] & mask == mask
            if not hit.all():
                alive, keys = alive[hit], keys[hit]
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray, probes: int) -> np.ndarray:
        """The level of each key, as many as answer without a gap: the first asked with ``probes`` bits."""
        out, alive, number = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 0
        while len(alive):
            number += 1
            alive = alive[self.has(keys[alive], number, probes if number == 1 else MORE_PROBES)]
            out[alive] = number
        return out


def level_members(keys: np.ndarray, counts: np.ndarray, probes: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Members of keys seen ``counts`` times, for FilterPart.build."""
    more = level_of(counts) - 1
    ends = np.cumsum(more)
    return [(keys, np.ones(len(keys), dtype=np.int64), probes), (np.repeat(keys, more), np.arange(int(more.sum())) - np.repeat(ends - more, more) + 2, MORE_PROBES)]


def ratio_digits(ratio: np.ndarray) -> np.ndarray:
    """Ratios of 2 ** -0.6 to 2 ** 0.6 as numbers of DIGITS binary digits."""
    return np.clip(np.rint((np.log2(ratio) + 0.6) / 1.2 * (2**DIGITS - 1)), 0, 2**DIGITS - 1).astype(np.int64)


class Parts:
    """Parts of a filter by number, from files of the shared folder; ``kept`` bytes stay if the folder isn't mounted."""

    def __init__(self, folder: str, files: dict[int, str], kept: int = 1 << 28):
        self.folder, self.files, self.kept = folder, files, kept
        self.held: OrderedDict[int, FilterPart] = OrderedDict()

    def __getstate__(self):
        return {**self.__dict__, "held": OrderedDict()}

    def __contains__(self, number: int) -> bool:
        return number in self.files

    def __getitem__(self, number: int) -> FilterPart:
        from pyarrow import fs

        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        system, path = fs.FileSystem.from_uri(self.folder)
        name = self.files[number]
        if isinstance(system, fs.LocalFileSystem):
            cells = np.asarray(np.memmap(f"{path}/{name}", dtype=np.uint64, mode="r"))
        else:
            with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                cells = np.frombuffer(stream.read(), dtype=np.uint64)
            while self.held and sum(p.cells.nbytes for p in self.held.values()) + cells.nbytes > self.kept:
                self.held.popitem(last=False)
        self.held[number] = FilterPart(cells)
        return self.held[number]


def write_part(folder: str, part: FilterPart) -> str:
    """The part's cells as a new file; its name. A task that runs again writes another file, and only the last is named."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(part.cells)
    return name


def split(keys: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each number in ``where`` with its keys and their places."""
    order = np.argsort(where, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(rows):
            yield int(where[rows[0]]), keys[rows], rows


def segment_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return (mix(pairs) % np.uint64(segments)).astype(np.int64)


def home_of(hashes: np.ndarray, homes: int) -> np.ndarray:
    """Where a word's count and normaliser are, by its hash's upper bits, which pairs know of their history."""
    return (mix(hashes >> LOW) % np.uint64(homes)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; each is narrowed, and its bytes are laid plane by plane, which compresses better."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        out.append((a.dtype.str, len(a), planes))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        dtype = np.dtype(kind)
        out.append(np.frombuffer(planes, dtype=np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
    return out


def pack_keys(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted keys as differences, with arrays in the same order."""
    order = np.argsort(keys)
    return pack(np.diff(keys[order], prepend=np.uint64(0)), *[o[order] for o in others])


def unpack_keys(blob: bytes) -> list[np.ndarray]:
    keys, *others = unpack(blob)
    return [np.cumsum(keys, dtype=np.uint64), *others]


class Block:
    """Some whole documents, their tokens as numbers of a vocabulary of their own."""

    def __init__(self, texts: list[bytes | None]):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        number = self.numbers.__getitem__
        lists = [list(map(number, (*(t or b"").lower().split(), END))) for t in texts]
        self.sizes = np.asarray([len(x) for x in lists], dtype=np.int64)
        self.tokens = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if lists else np.zeros(0, dtype=np.int64)
        begin = number(BEGIN)
        self.hashes = np.asarray([xxhash.xxh64_intdigest(w) for w in self.numbers], dtype=np.uint64)
        self.numbers.default_factory = None  # it holds the dictionary, which would live until the collector came by
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[begin], self.tokens[:-1]])
        before[self.starts] = begin
        self.pairs = before * len(self.hashes) + self.tokens
        self.begin = begin

    def pair_keys(self, pairs: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        return pair_hash(self.hashes[pairs // n], self.hashes[pairs % n])


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with about BLOCK_BYTES of text, so at least one document."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy()) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a), Block(column.slice(a, b - a).to_pylist())


def _count_blocks(segments: int, homes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches, 0):
            words = np.bincount(block.tokens, minlength=len(block.hashes))
            seen = words > 0
            pairs, times = np.unique(block.pairs, return_counts=True)
            keys = block.pair_keys(pairs)
            rows: dict[int, list] = defaultdict(lambda: [b"", b"", 0])
            for home, part, at in split(block.hashes[seen], home_of(block.hashes[seen], homes)):
                rows[home][0] = pack_keys(part, words[seen][at])
            for segment, part, at in split(keys, segment_of(keys, segments)):
                rows[segment][1] = pack_keys(part, times[at])
            # the begin of a text counts as a history, not as a word
            rows[int(home_of(block.hashes[[block.begin]], homes)[0])][2] = len(block.sizes)
            got = sorted(rows.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in got], pa.int32()), pa.array([v[0] for _, v in got], pa.binary()), pa.array([v[1] for _, v in got], pa.binary()), pa.array([v[2] for _, v in got], pa.int64())],
                names=["segment", "words", "pairs", "texts"],
            )

    return count


def _sum_blobs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blobs and their summed counts."""
    parts = [unpack_keys(b) for b in blobs if len(b)]
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c.astype(np.int64) for _, c in parts])
    del parts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


SEGMENTS = "segment int, home int, words binary, sums binary, texts bigint, file string, false double, singles bigint"
HOMES = "home int, counts binary, file string, n_words bigint, n_tokens bigint, quantised double, histories binary"


def _build_segment(folder: str, homes: int):
    """A segment's part of the pairs' filter (home -1), and for each home its histories with sums of quantised counts."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        segment = int(group["segment"].iloc[0])
        pairs, times = _sum_blobs(group["pairs"].tolist())
        part = FilterPart.build(level_members(pairs, times, PAIR_PROBES))
        out = [(segment, -1, b"", b"", 0, write_part(folder, part), part.false, int((times == 1).sum()))]
        if len(pairs):
            history = pairs >> LOW
            first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
            sums = np.add.reduceat(doubled_counts()[level_of(times)], first)
            history = history[first]
            out += [(segment, home, b"", pack_keys(keys, sums[at]), 0, "", 0.0, 0) for home, keys, at in split(history, home_of(history << LOW, homes))]
        words, counts = _sum_blobs(group["words"].tolist())
        texts = int(group["texts"].sum())
        if len(words) or texts:
            out.append((segment, segment, pack(words, counts), b"", texts, "", 0.0, 0))
        give_back()
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in SEGMENTS.split(", ")])

    return build


def _build_home(folder: str):
    """Exact counts of a home's words and the part of the filter with their levels and normalisers."""
    begin = np.uint64(xxhash.xxh64_intdigest(BEGIN))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = [unpack(b) for b in group["words"] if len(b)]
        words, counts = (found[0][0], found[0][1].astype(np.int64)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        texts = int(group["texts"].sum())
        known = np.append(words, begin) if texts else words
        times = np.append(counts, texts) if texts else counts
        history, sums = _sum_blobs(group["sums"].tolist())
        at = np.minimum(np.searchsorted(history, known >> LOW), max(len(history) - 1, 0))
        total = np.where(history[at] == known >> LOW, sums[at], 0) if len(history) else np.zeros(len(known), dtype=np.int64)
        keys, levels = unigram_key(known), level_of(times)
        members = level_members(keys, times, WORD_PROBES)
        some = (total > 0) & (levels > EXACT_LEVEL)
        digits = ratio_digits(total[some] / doubled_counts()[levels[some]])
        for i in range(DIGITS):
            on = keys[some][digits >> i & 1 == 1]
            members.append((on, np.full(len(on), DIGIT_NUMBER + i), DIGIT_PROBES))
        part = FilterPart.build(members)
        quantised = float(counts_of_levels()[level_of(counts)].sum())
        histories = np.bincount(levels[total > 0], minlength=len(counts_of_levels()))
        row = (int(group["home"].iloc[0]), pack(words, counts), write_part(folder, part), len(words), int(counts.sum()), quantised, pickle.dumps(histories))
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in HOMES.split(", ")])

    return build


def unigram_key(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))


def doubled_counts() -> np.ndarray:
    """Twice counts_of_levels(): integers, whose sums don't depend on an order."""
    return np.rint(2 * np.minimum(counts_of_levels(), 2.0**60)).astype(np.int64)


def prior_weight(singles: int, histories: np.ndarray) -> float:
    """m of the module's formula, from the pairs seen once and the number of histories at each level.

    Where m u(w) is small beside 1, the likelihood of each pair by all others has its maximum where
    singles = m * sum over histories of S / (S - 1 + m); histories seen once say nothing of m.
    """
    count = counts_of_levels()[: len(histories)]
    singles = singles - int(histories[1])
    size, many = count[2:], histories[2:]
    low, high = 1.0, 1e6
    for _ in range(60):
        m = (low * high) ** 0.5
        low, high = (m, high) if m * (many * size / (size - 1 + m))[many > 0].sum() < singles else (low, m)
    return low


class Model:
    """The filter's parts, totals and m; log10 probabilities of a block's documents."""

    def __init__(self, pairs: Parts, words: Parts, segments: int, homes: int, total: float, distinct: int, prior: float, false: float):
        self.pairs, self.words, self.segments, self.homes = pairs, words, segments, homes
        self.total, self.distinct, self.prior, self.false = total, distinct, prior, distinct * false

    def word_levels(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of each word, and S of it as a history."""
        levels, sums, keys = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes)), unigram_key(hashes)
        for home, part, rows in split(keys, home_of(hashes, self.homes)):
            if home in self.words:
                found = self.words[home]
                levels[rows] = found.levels(part, WORD_PROBES)
                sums[rows] = counts_of_levels()[levels[rows]]
                many = rows[levels[rows] > EXACT_LEVEL]
                digits = np.zeros(len(many), dtype=np.int64)
                for i in range(DIGITS):
                    digits += found.has(keys[many], DIGIT_NUMBER + i, DIGIT_PROBES).astype(np.int64) << i
                sums[many] *= 2.0 ** (digits * 1.2 / (2**DIGITS - 1) - 0.6)
        return levels, sums

    def pair_levels(self, keys: np.ndarray) -> np.ndarray:
        levels = np.zeros(len(keys), dtype=np.int64)
        for segment, part, rows in split(keys, segment_of(keys, self.segments)):
            if segment in self.pairs:
                levels[rows] = self.pairs[segment].levels(part, PAIR_PROBES)
        return levels

    def log_probabilities(self, keys: np.ndarray, history: np.ndarray, word: np.ndarray, levels: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """log10 p of pairs with these keys, given places of their history and word in levels and sums."""
        table = counts_of_levels()
        single = (table[levels[word]] + 1) / (self.total + self.distinct + 1)
        # a pair of an unseen word isn't probed; one isn't more frequent than its words: more than that is false
        found = np.zeros(len(keys), dtype=np.int64)
        maybe = np.flatnonzero((levels[history] > 0) & (levels[word] > 0))
        found[maybe] = np.minimum(self.pair_levels(keys[maybe]), np.minimum(levels[history[maybe]], levels[word[maybe]]))
        false = np.where(levels[history] > 0, self.false, 0.0)
        return np.log10((table[found] + self.prior * single) / (sums[history] + self.prior + false))

    def score(self, block: Block) -> np.ndarray:
        levels, sums = self.word_levels(block.hashes)
        pairs, where = np.unique(block.pairs, return_inverse=True)
        n = len(block.hashes)
        log = self.log_probabilities(block.pair_keys(pairs), pairs // n, pairs % n, levels, sums)
        return np.add.reduceat(log[where], block.starts)


def _score_blocks(shared, hot_keys: np.ndarray, hot_logs: np.ndarray):
    """Rows of two kinds: one of each block with its documents, and one of each block and home with rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        model: Model = shared.value
        for batch, block in blocks(batches, 2):
            name = (task << 32) + serial
            serial += 1
            size, documents = len(block.hashes), len(block.sizes)
            score = model.score(block)
            at = np.searchsorted(hot_keys, block.hashes)
            at = np.minimum(at, max(len(hot_keys) - 1, 0))
            hot = hot_keys[at] == block.hashes if len(hot_keys) else np.zeros(size, dtype=bool)
            logs = np.where(hot, hot_logs[at], 0.0) if len(hot_keys) else np.zeros(size)
            base = np.add.reduceat(logs[block.tokens], block.starts)
            known = np.add.reduceat(hot[block.tokens].astype(np.int64), block.starts)
            owner = np.repeat(np.arange(documents), block.sizes)
            rare = ~hot[block.tokens]
            cells, times = np.unique(block.tokens[rare] * documents + owner[rare], return_counts=True)
            word, doc = cells // documents, cells % documents
            used = np.flatnonzero(np.bincount(word, minlength=size)) if len(word) else np.zeros(0, dtype=np.int64)
            ids = batch.column(0)
            head = pickle.dumps((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), block.sizes, known, base, score))
            rows = [(name, -1, head)]
            first, last = np.searchsorted(word, used), np.searchsorted(word, used, side="right")
            for home, keys, place in split(block.hashes[used], home_of(block.hashes[used], model.homes)):
                mine = place[np.argsort(keys)]
                spans = last[mine] - first[mine]
                take = np.repeat(first[mine] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
                rows.append((name, home, pack(np.diff(np.sort(keys), prepend=np.uint64(0)), spans, doc[take], times[take])))
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "home", "blob"])

    return run


def _answer(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each block that asks a home: documents, sum of log10(c + 1) and tokens with c > 0 of its rare words."""
    known, numbers = unpack(counts["counts"].iloc[0]) if len(counts) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    out = []
    for block, blob in zip(asked["block"], asked["blob"], strict=True):
        gaps, spans, doc, times = unpack(blob)
        keys = np.cumsum(gaps, dtype=np.uint64)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        c = np.where(known[at] == keys, numbers[at], 0) if len(known) else np.zeros(len(keys), dtype=np.int64)
        each, times = np.repeat(c, spans.astype(np.int64)), times.astype(np.int64)
        docs, where = np.unique(doc, return_inverse=True)
        out.append((block, -2, pickle.dumps((docs, np.bincount(where, np.log10(each + 1.0) * times), np.bincount(where, (each > 0) * times)))))
    return pd.DataFrame(out, columns=["block", "home", "blob"])


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the answers of all homes added, in a fixed order."""
    head = pickle.loads(group.loc[group["home"] == -1, "blob"].iloc[0])
    ids, valid, held, sizes, known, base, score = head
    known, base = known.copy(), base.copy()
    answers = sorted((pickle.loads(b) for b in group.loc[group["home"] == -2, "blob"]), key=lambda x: (len(x[0]), x[1].tobytes()))
    for docs, logs, some in answers:
        base[docs] += logs
        known[docs] += some.astype(np.int64)
    frame = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": held.astype(bool), "n_tokens": sizes, "n_known": known, "base_sum": base, "score": score})
    frame.loc[~valid, "doc_id"] = pd.NA
    return frame


def train_model(learn: DataFrame, segment_bytes: int = 16 << 20) -> tuple[Model, DataFrame]:
    """The model of the column ``text`` (null as empty) and, by home, the exact counts of its words."""
    spark = learn.sparkSession
    octets = learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(1, -(-octets // segment_bytes))
    homes = segments
    folder = new_folder(spark, "ngrams")
    counted = learn.mapInArrow(tidy(_count_blocks(segments, homes)), "segment int, words binary, pairs binary, texts bigint")
    # as many tasks as segments, so none grows with the corpus
    rows = written(counted.repartition(segments, "segment").groupBy("segment").applyInPandas(_build_segment(folder, homes), SEGMENTS), "segments")
    parts = written(rows.where("home >= 0").groupBy("home").applyInPandas(_build_home(folder), HOMES), "words")
    pairs = {r["segment"]: r["file"] for r in rows.where("home = -1").select("segment", "file").orderBy("segment").toLocalIterator()}
    singles, false = rows.where("home = -1").agg(F.sum("singles"), F.avg("false")).first()
    remove(spark, rows.written_path)
    words, total, distinct, histories = {}, 0.0, 0, np.zeros(len(counts_of_levels()), dtype=np.int64)
    for r in parts.drop("counts").orderBy("home").toLocalIterator():
        words[r["home"]] = r["file"]
        total, distinct, histories = total + r["quantised"], distinct + r["n_words"], histories + pickle.loads(r["histories"])
    return Model(Parts(folder, pairs), Parts(folder, words), segments, homes, total, distinct, prior_weight(singles or 0, histories), false or 0.0), parts


def score_documents(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = 16 << 20, hot_share: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the non-blank runs of the whole text (A-Z lower-cased) and one end. The model learns from the rows that
    are not held out: bigram and unigram counts, quantised in the filter, smoothed by Dirichlet priors whose weight all
    training pairs give. base_score uses exact counts of words, told apart by 64-bit hashes: words that are at least
    1 / ``hot_share`` of the tokens (so at most ``hot_share`` words) go to the workers, others are looked up at the home
    of their hash. Null texts are empty and have the end only; repeated rows each count and are each scored; null ids
    stay null; other columns are not read; an empty table gives no rows, and with nothing to learn from all counts
    are 0 and ``score`` is that of unseen words. One segment of the hash space stands for ``segment_bytes`` of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    model, parts = train_model(rows.where(~F.col("held_out")).select("text"), segment_bytes)
    tokens = int(parts.agg(F.sum("n_tokens")).first()[0] or 0)
    least = max(1, -(-tokens // hot_share))

    def hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for blob in frame["counts"]:
                keys, counts = unpack(blob)
                counts = counts.astype(np.int64)
                yield pd.DataFrame({"key": keys[counts >= least].view(np.int64), "n": counts[counts >= least]})

    found = parts.select("counts").mapInPandas(hot, "key bigint, n bigint").toPandas() if tokens else pd.DataFrame({"key": [], "n": []}, dtype="int64")
    keys = found["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    logs = np.log10(found["n"].to_numpy(dtype=np.float64) + 1)[order]
    asked = written(rows.mapInArrow(tidy(_score_blocks(spark.sparkContext.broadcast(model), keys[order], logs)), "block bigint, home int, blob binary"), "asked")
    wanted = asked.where("home >= 0")
    answers = parts.select("home", "counts").groupBy("home").cogroup(wanted.groupBy("home")).applyInPandas(_answer, "block bigint, home int, blob binary")
    scored = asked.where("home = -1").unionByName(answers).groupBy("block").applyInPandas(_gather, SCORES)
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(float(np.log10(tokens + model.distinct + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
