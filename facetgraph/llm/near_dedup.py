"""Near-duplicates of word shingles by DartMinHash signatures and banded joining, checked exactly.

Every weighted shingle owns a strip of the plane from 0 to its weight; hashed darts fall on the plane at a steady
rate, and a document's signature has, for each coordinate, the earliest dart that hits one of its strips. Two documents
share a coordinate's dart with a chance that is their generalised Jaccard similarity. Exact copies (of the words) are
one node from the start; bands of the signature give candidate links, and each link is checked on the shingles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import tidy, written
from facetgraph.llm.graph import components

WIDTH = 5
#: Signature: BANDS bands of ROWS coordinates. A pair of similarity 0.8 shares no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Counters by which shingles are put in order, rare ones first; shingles that share a counter cost time alone.
SLOTS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def step(number: int) -> np.uint64:
    """number times the golden constant, modulo 2**64."""
    return np.uint64(int(_GOLDEN) * number % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Shingles:
    """Weighted shingles of some texts: doc (index), key (64-bit), weight (count), sorted by doc and key.

    A text of fewer than WIDTH words is one shingle of all its words; one without words has none.
    """

    def __init__(self, lists: list[list[str]]):
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        number = numbers.__getitem__
        sizes = np.asarray([len(x) for x in lists], dtype=np.int64)
        tokens = np.fromiter((n for x in lists for n in map(number, x)), dtype=np.int64, count=int(sizes.sum()))
        hashes = np.asarray([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)
        numbers.default_factory = None  # it holds the dictionary, which would live until the collector came by
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(lists)), sizes)
        h = hashes[tokens] if len(tokens) else np.zeros(0, dtype=np.uint64)
        key, place = np.zeros(len(h), dtype=np.uint64), np.arange(len(h))
        for i in range(WIDTH):
            inside = place + i < ends
            ahead = np.zeros_like(key)
            ahead[inside] = h[(place + i)[inside]]
            key = mix(key + ahead + step(i + 1))
        first = np.cumsum(sizes) - sizes
        keep = (place + WIDTH <= ends) | (place == np.repeat(first, sizes))
        owner, key = owner[keep], key[keep]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        self.doc, self.key = owner[at], key[at]
        self.weight = np.diff(np.append(at, len(key)))
        self.count = len(lists)


def dart_signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, count: int, coordinates: int = COORDINATES) -> np.ndarray:
    """[count, coordinates] of 64-bit darts; rows of documents without elements are 0.

    An element's axis is cut into strips [0, 1), [1, 2), [2, 4), ... In each, darts arrive in time at a rate that is
    its width, by hashed exponential gaps, and fall on a hashed height: those below the weight count. Time is bounded
    for each document so that its weight is expected to catch coordinates * (ln coordinates + 4) darts; documents that
    leave a coordinate empty go on to twice the time, which changes none of their earlier darts.
    """
    signature = np.zeros((count, coordinates), dtype=np.uint64)
    total = np.bincount(doc, weight, count)
    limit = coordinates * (np.log(coordinates) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        own = todo[doc]
        d, k, w = doc[own], key[own], weight[own].astype(np.float64)
        strips = np.where(w > 1, 1 + np.ceil(np.log2(np.maximum(w, 1))), 1).astype(np.int64)
        element = np.repeat(np.arange(len(d)), strips)
        level = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.where(level > 1, low, 1.0)
        seed = mix(k[element] + _GOLDEN * (level + 1).astype(np.uint64))
        time, until, d, w = np.zeros(len(element)), limit[d[element]], d[element], w[element]
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 0
        while len(seed):
            number += 1
            x = mix(seed + step(number))
            y = mix(x + _GOLDEN)
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
            live = time <= until
            seed, time, until, d, w, low, width, x, y = (v[live] for v in (seed, time, until, d, w, low, width, x, y))
            hit = low + width * ((y >> np.uint64(32)).astype(np.float64) / 2.0**32) < w
            cell = d[hit] * coordinates + (y[hit] % np.uint64(coordinates)).astype(np.int64)
            darts.append((cell, time[hit], x[hit]))
        cell, when, dart = (np.concatenate(v) for v in zip(*darts, strict=True))
        order = np.lexsort((dart, when))[::-1]  # the earliest is written last
        flat = signature.reshape(-1)
        flat[cell[order]] = dart[order] | np.uint64(1)
        todo = todo & (signature == 0).any(axis=1)
        limit = limit * 2
    return signature


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """[documents, BANDS]: one number a band, different for different bands."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros(rows.shape[:2], dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + rows[:, :, i] + step(i + 1))
    return mix(out + np.arange(BANDS, dtype=np.uint64))


#: Characters whose shingles are made at a time; a longer text is taken alone.
PART_CHARS = 1_000_000


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of a batch of about PART_CHARS, each with its texts' words; the texts of other slices stay in Arrow."""
    texts = batch.column(column)
    ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy()) // PART_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a), [words_of(t.as_py()) for t in texts.slice(a, b - a)]


def text_key(words: list[str]) -> bytes:
    """128 bits of the words in order; equal for texts that differ in blanks and case alone."""
    return xxhash.xxh3_128_digest(" ".join(words))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, lists in _parts(batch, 1):
            s = Shingles(lists)
            bands = band_hashes(dart_signatures(s.doc, s.key, s.weight, s.count))
            sizes = np.bincount(s.doc, s.weight, s.count).astype(np.int64)
            raw = bands.tobytes()
            blobs = [raw[i * BANDS * 8 : (i + 1) * BANDS * 8] if sizes[i] else None for i in range(s.count)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([text_key(w) for w in lists], pa.binary()), pa.array(sizes), pa.array(blobs, pa.binary())], names=["doc_id", "text_key", "n", "bands"]
            )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).to_pylist()
        bands = np.frombuffer(b"".join(raw), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(bands), pa.array(np.repeat(batch.column(2).to_numpy(), BANDS))], names=["node", "bucket", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles as a set of longs, the second and further occurrence being elements of their own."""
    for batch in batches:
        for _, lists in _parts(batch, 0):
            s = Shingles(lists)
            again = np.arange(int(s.weight.sum())) - np.repeat(np.cumsum(s.weight) - s.weight, s.weight)
            key = np.repeat(s.key, s.weight)
            key = np.where(again > 0, mix(key + _GOLDEN * again.astype(np.uint64)), key).view(np.int64)
            sizes = np.bincount(s.doc, s.weight, s.count).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key))
            yield pa.RecordBatch.from_arrays([pa.array([text_key(w) for w in lists], pa.binary()), sets], names=["text_key", "shingles"])


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, n, size of buckets with two nodes or more; sums come before rows meet."""
    rows = nodes.where("bands is not null").select("node", "bands", "n").mapInArrow(tidy(_buckets), "node bigint, bucket bigint, n bigint")
    met = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("bucket", "shared")
    met = written(met, "buckets")
    return written(rows.join(met, F.col("bucket") == F.col("shared")).select("bucket", "node", "n", "size"), "shared")


def _fits(similarity: float):
    return F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity


def small_bucket_pairs(shared: DataFrame, whole: int, similarity: float) -> DataFrame:
    """All pairs (a, b), a < b, of buckets of at most ``whole`` nodes, if their sizes allow the similarity."""
    members = shared.where(F.col("size") <= whole).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    place = members.select("m", F.posexplode("m").alias("i", "x"))
    pairs = place.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    return pairs.where(_fits(similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def large_buckets(shared: DataFrame, nodes: DataFrame, whole: int) -> DataFrame:
    """node, n, bands, buckets of each node in buckets of over ``whole`` nodes; buckets has those buckets."""
    big = shared.where(F.col("size") > whole).groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    return nodes.select("node", "n", "bands").join(big, "node")


def label(large: DataFrame, links: DataFrame) -> DataFrame:
    """``large`` with the component of each node, ``root``."""
    roots = components(links).withColumnRenamed("node", "c")
    return written(large.join(roots, F.col("node") == F.col("c"), "left").withColumn("root", F.coalesce("root", "node")).drop("c"), "labelled")


def neighbours(labelled: DataFrame, shift: int, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of different components next to each other in large buckets ordered by three other bands.

    Nodes that share several bands come to lie together. The order is dealt out by ranges, so no bucket is one task;
    the pair at the end of a range is left to crossing_pairs.
    """
    names = ["bucket", "s1", "s2", "s3", "node", "n", "root"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, root, blobs, lists = (batch.column(i) for i in range(5))
            bands = np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.int64).reshape(-1, BANDS)
            owner, bucket = np.repeat(np.arange(len(bands)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            at = (bands[owner] == bucket[:, None]).argmax(axis=1)
            later = [bands[owner, (at + shift + i) % BANDS] for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket, *later, *(x.to_numpy()[owner] for x in (node, n, root)))], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((4, 0), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(i).to_numpy() for i in range(4)])], axis=1)
            last = rows[:, -1:]
            (bucket, node, n, root), x, y = rows, slice(None, -1), slice(1, None)
            near = (bucket[x] == bucket[y]) & (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * similarity)
            yield pa.RecordBatch.from_arrays([pa.array(f(node[x], node[y])[near]) for f in (np.minimum, np.maximum)], names=["a", "b"])

    # written, since dealing out by ranges reads the rows twice
    rows = written(labelled.select("node", "n", "root", "bands", "buckets").mapInArrow(tidy(order), ", ".join(f"{c} bigint" for c in names)), "ordered")
    dealt = rows.repartitionByRange(*names[:5]).sortWithinPartitions(*names[:5])
    return dealt.select("bucket", "node", "n", "root").mapInArrow(compare, "a bigint, b bigint").distinct()


def mixed_buckets(labelled: DataFrame) -> DataFrame:
    """Buckets (at) of several components. A node's buckets meet in counts, not in rows."""
    rows = labelled.select("root", F.explode("buckets").alias("at")).groupBy("at")
    return written(rows.agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("at"), "mixed")


def open_nodes(labelled: DataFrame, mixed: DataFrame) -> DataFrame:
    """node, root of the components that have a node in a mixed bucket."""
    met = labelled.select("root", F.explode("buckets").alias("bucket")).distinct()
    roots = met.join(mixed, F.col("bucket") == F.col("at"), "left_semi").select(F.col("root").alias("r")).distinct()
    return labelled.join(roots, F.col("root") == F.col("r"), "left_semi").select("node", "root")


def prefixes(own: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """node, root, n, key, place, short: of each set (node, root, s) the first shingles, those of rare counters first.

    With A the sizes' smaller set and B the larger, sets of the similarity share at least similarity * |B| and
    2 * similarity / (1 + similarity) * |A| shingles, so one of the first |B| - similarity * |B| + 1 of B is among the
    first |A| - 2 * similarity / (1 + similarity) * |A| + 1 of A, the ``short`` ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = part.column(2)
                n, key = sets.value_lengths().to_numpy(), sets.flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((key, counts[key % SLOTS], owner))
                place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                long = n - np.ceil(similarity * n - 1e-9) + 1
                short = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
                keep = place < long[owner]
                owner, key, place = owner[keep], key[order][keep], place[keep]
                columns = [part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), n[owner].astype(np.int64), key, place.astype(np.int32), place < short[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["node", "root", "n", "key", "place", "short"])

    return own.mapInArrow(tidy(run), "node bigint, root bigint, n bigint, key bigint, place int, short boolean")


def crossing_pairs(nodes: DataFrame, sets: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """All pairs (a, b), a < b, of different components that can have the similarity, of nodes (node, root).

    A join of prefixes of the shingles, whatever the bucket: pairs that are left out are under the similarity.
    """
    nodes = written(nodes.select(F.col("node").alias("m"), "root"), "open")
    if nodes.count() <= broadcast_rows:
        nodes = F.broadcast(nodes)
    own = sets.join(nodes, F.col("node") == F.col("m")).select("node", "root", "s")
    found = own.select(F.explode("s").alias("key")).groupBy(F.pmod("key", F.lit(SLOTS)).alias("slot")).count().toArrow()
    counts = np.zeros(SLOTS, dtype=np.uint32)
    counts[found["slot"].to_numpy()] = np.minimum(found["count"].to_numpy(), 0xFFFFFFFF)
    rows = written(prefixes(own, counts, similarity), "prefixes")
    several = rows.groupBy(F.col("key").alias("k")).agg((F.min("root") != F.max("root")).alias("several")).where("several").select("k")
    rows = written(rows.join(several, F.col("key") == F.col("k"), "left_semi"), "crossing")
    x, y = rows.where("short").alias("x"), rows.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    sized = F.col("x.n") >= F.col("y.n") * similarity - 1e-9
    # the first shingle that both have: no more than what follows it is shared
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ordered & sized & rest)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def all_links(rows: DataFrame, nodes: DataFrame, similarity: float, whole: int, broadcast_rows: int) -> DataFrame:
    """Checked links, enough of them to connect what links connect.

    Small buckets check all their pairs. In large ones each node is checked with its neighbours in an order of other
    bands, in two rounds. Nodes of buckets that hold several components even so are joined by prefixes of their
    shingles: each pair of different components is checked or can't be a link.
    """
    shared = shared_buckets(nodes)
    sets = shingle_sets(rows, nodes, shared, broadcast_rows)
    large = written(large_buckets(shared, nodes, whole), "large")
    pairs = small_bucket_pairs(shared, whole, similarity).unionByName(neighbours(large.withColumn("root", F.col("node")), 0, similarity)).distinct()
    links = written(check(pairs, sets, similarity), "checked")
    if large.isEmpty():
        return links
    labelled = label(large, links)
    links = written(links.unionByName(check(neighbours(labelled, 3, similarity), sets, similarity)), "checked")
    labelled = label(large, links)
    mixed = mixed_buckets(labelled)
    if mixed.isEmpty():
        return links
    fresh = check(crossing_pairs(open_nodes(labelled, mixed), sets, similarity, broadcast_rows), sets, similarity)
    return written(links.unionByName(fresh), "checked")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, whole: int = 24, broadcast_rows: int = 500_000
) -> DataFrame:
    """doc_id, text_key, class_id, class_size, class_root of every row.

    A link joins two different word sequences whose five-word shingles, as multisets, have a Jaccard similarity of
    ``similarity`` or more; classes are what links and exact copies connect. class_id is the class's least doc_id,
    class_size its rows, class_root a number of the class in this run. Case and blanks don't count. Null, empty and
    blank texts are copies of each other; a text of under five words is one shingle. Repeated rows are copies; null
    ids stay null and are the class_id only of classes without another id. Other columns are not read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(tidy(_sign), "doc_id bigint, text_key binary, n bigint, bands binary"), "signatures")
    nodes = signed.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = components(all_links(rows, nodes, similarity, whole, broadcast_rows))
    small = nodes.select("node", "text_key", "least_id", "copies")
    rooted = found.join(small, "node")
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")).withColumnRenamed("root", "r")
    linked = rooted.join(classes, F.col("root") == F.col("r")).select(F.col("node").alias("l"), "class_id", "class_size", "root")
    settled = small.join(linked, F.col("node") == F.col("l"), "left").select(
        F.col("text_key").alias("k"),
        F.when(F.col("l").isNotNull(), F.col("class_id")).otherwise(F.col("least_id")).alias("class_id"),
        F.coalesce("class_size", "copies").alias("class_size"),
        F.coalesce("root", "node").alias("class_root"),
    )
    return signed.select("doc_id", "text_key").join(settled, F.col("text_key") == F.col("k")).drop("k")


def shingle_sets(rows: DataFrame, nodes: DataFrame, shared: DataFrame, broadcast_rows: int) -> DataFrame:
    """node and s, its shingles, of the nodes in shared buckets: made again from their texts alone."""
    wanted = nodes.join(shared.select("node"), "node", "left_semi").select("node", F.col("text_key").alias("k"), F.col("least_id").alias("of"))
    wanted = written(wanted, "wanted")
    ids = wanted.select("of").distinct()
    if wanted.count() <= broadcast_rows:
        ids = F.broadcast(ids)  # at most broadcast_rows longs
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_sets), "text_key binary, shingles array<bigint>").join(wanted, F.col("text_key") == F.col("k"))
    return written(sets.groupBy("node").agg(F.any_value("shingles").alias("s")), "sets")


def check(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles have the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    pair = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return pair.where(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def _with_keys(place: int):
    """Adds the key of the text, which is the row's column number ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(words_of(t.as_py())) for t in batch.column(0).field(place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["row", "id", "text_key"])

    return run


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each class of near_duplicates: one with the class's least doc_id.

    If rows with that id tie, the least text key stays, and of repeated rows one. Columns stay, whatever their names.
    """
    found = written(near_duplicates(docs, doc_id=doc_id, text=text, similarity=similarity), "classes")
    # equal ids in one class tie by text key; a class without ids ties by text key alone
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_root").agg(F.min("text_key").alias("k"), F.first("class_id").alias("of"))
    once = found.groupBy("text_key", "doc_id").count().where("count > 1").select(F.col("text_key").alias("k2"), F.col("doc_id").alias("of2"))
    kept = firsts.join(once, (F.col("k") == F.col("k2")) & F.col("of").eqNullSafe(F.col("of2")), "left").select("k", "of", F.col("k2").isNotNull().alias("again"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("id"))
    schema = T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("text_key", T.BinaryType())])
    chosen = rows.mapInArrow(tidy(_with_keys(docs.columns.index(text))), schema).join(kept, (F.col("text_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("of")))
    several = chosen.where("again").groupBy("k").agg(F.any_value("row").alias("row"))
    return chosen.where("not again").select("row.*").unionByName(several.select("row.*"))
