"""WARC archives of pages and their merged capture index.

Pages are written as gzip members to archives of bounded size in the shared folder. Each archive, read back, yields a
run of captures sorted by URL key and time; ranges of keys are dealt out, and each range's runs are merged by a loser
tree into capture histories that are ordered over the whole collection.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.llm.common import new_folder, written

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CAPTURES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("captured", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; lower case, no scheme, ``www.`` or fragment."""
    rest = (url or "").split("#", 1)[0].lower()
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut].removeprefix("www."), rest[cut:] or "/"
    return ",".join(reversed(host.split("."))) + ")" + tail


def _header_value(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def warc_record(page_id: int | None, url: str | None, when: datetime, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One response record, or a revisit record whose block holds the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {_header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_members(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    view, at = memoryview(archive), 0
    while at < len(view):
        begin, parts, unpack = at, [], zlib.decompressobj(31)
        while not unpack.eof:
            part = view[at : at + (1 << 20)]
            if not part:
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield begin, b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers, payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


class LoserTree:
    """Merges k sorted iterators: inner nodes hold the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(run, None) for run in runs]
        self.keys = [self._key(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._less(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def _key(self, i: int):
        return (1,) if self.heads[i] is None else (0, self.key(self.heads[i]), i)

    def _less(self, i: int, j: int) -> bool:
        return self.keys[i] < self.keys[j]

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = self._key(i)
            node = (i + self.k) // 2
            while node:
                if self._less(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _decide(pages: DataFrame, smallest: int, broadcast_rows: int) -> DataFrame:
    """page_id, url, payload, size, sha1, refers_to, revisit of every row.

    Of equal payloads of at least ``smallest`` bytes the least page_id is the response. Hot payloads are counted
    before they meet. Only pages that aren't the one response of their payload have a decision; up to
    ``broadcast_rows`` of them go to the pages, beyond that pages are joined by page_id, which no payload makes hot.
    Repeated rows of the least page_id are one response, with the least URL, and revisits.
    """
    key = pages.groupBy("page_id", "sha1").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    big = key.where(F.col("size") >= smallest)
    first = big.groupBy("sha1").agg(F.min("page_id").alias("first"))
    same = F.col("d.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("d.sha1") == F.col("p.sha1"))
    decision = big.join(first, "sha1").select("page_id", "sha1", "copies", "first")
    decision = written(decision.where(~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("copies") > 1)), "decisions")
    if decision.count() <= broadcast_rows:
        decision = F.broadcast(decision)  # at most broadcast_rows rows of under 100 bytes
    joined = pages.alias("p").join(decision.alias("d"), same, "left").select("p.*", "d.copies", "d.first")
    is_first = F.col("copies").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    several = is_first & (F.coalesce(F.col("copies"), F.lit(1)) > 1)
    single = joined.where(~several).select("page_id", "url", "payload", "size", "sha1", F.when(~is_first, F.col("first")).alias("refers_to"), (~is_first).alias("revisit"))
    repeated = joined.where(several)
    one = repeated.groupBy("page_id", "sha1").agg(F.min("url").alias("url"), F.any_value("payload").alias("payload"), F.max("size").alias("size"))
    responses = one.select("page_id", "url", "payload", "size", "sha1", F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("revisit"))
    urls = repeated.groupBy("page_id", "sha1", "url").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    least = one.select(F.col("page_id").alias("i"), F.col("sha1").alias("h"), F.col("url").alias("u"))
    taken = F.col("page_id").eqNullSafe(F.col("i")) & (F.col("sha1") == F.col("h")) & F.col("url").eqNullSafe(F.col("u"))
    left = urls.join(least, taken, "left").withColumn("n", F.col("n") - F.col("h").isNotNull().cast("int")).where("n > 0")
    spread = left.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n"))))
    others = spread.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha1", F.col("page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    return single.unionByName(responses).unionByName(others)


def write_archives(records: DataFrame, folder: str, archive_bytes: int, level: int) -> DataFrame:
    """Writes records (see _decide, with ``captured`` in epoch seconds) and returns the archives' names and sizes.

    A task writes part-<task>-<n>.warc.gz; rows are sorted, so a task run again writes the same files over.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        parts: list[bytes] = []
        size = number = 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal size, number
            name = f"part-{context.partitionId():06d}-{number:06d}.warc.gz"
            system.create_dir(path)
            part = f"{path}/.{name}.{context.taskAttemptId()}"
            with system.open_output_stream(part, compression=None) as out:
                for p in parts:
                    out.write(p)
            system.move(part, f"{path}/{name}")
            done.append((name, size))
            parts.clear()
            size, number = 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                when = EPOCH + timedelta(seconds=row["captured"])
                record = warc_record(row["page_id"], row["url"], when, row["payload"] or b"", row["size"], digest, row["refers_to"], row["revisit"])
                member = gzip_member(record, level)
                parts.append(member)
                size += len(member)
                if size >= archive_bytes:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["archive", "bytes"])

    return written(records.mapInArrow(write, "archive string, bytes bigint"), "archives")


def read_runs(spark, folder: str) -> DataFrame:
    """Each archive's captures as one run sorted by URL key, time and page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                run = []
                for offset, record in read_members(content.as_buffer()):
                    fields, http, payload = parse_record(record)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"{archive} at {offset}: the payload isn't that of its digest")
                    size = int(http["Content-Length"]) if revisit else len(payload)
                    refers = _number(fields["WARC-Refers-To"]) if revisit else None
                    run.append((_number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers, url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], archive.as_py(), offset))
                run.sort(key=capture_order)
                columns = list(zip(*run, strict=True)) or [()] * len(CAPTURES.names)
                kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in CAPTURES.fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=CAPTURES.names)

    return files.mapInArrow(read, CAPTURES)


def capture_order(row: tuple) -> tuple:
    """URL key, time, page (null first), then place."""
    return row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8]


def merge_runs(runs: DataFrame, per_range: int, count: int) -> DataFrame:
    """All captures in ranges of the order, with history_range and history_position: together the global order.

    Ranges are cut on the whole order, not on the key alone, so a key with many captures is dealt out too.
    """
    ranges = max(1, -(-count // per_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        by_run: dict[str, list[tuple]] = {}
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in frame.itertuples(index=False, name=None):
                by_run.setdefault(row[7], []).append(row)
        ordered = []
        for name in sorted(by_run):
            rows = by_run[name]
            keys = [capture_order(r) for r in rows]
            if any(a > b for a, b in zip(keys, keys[1:], strict=False)):  # the exchange may deal a run's rows in another order
                rows.sort(key=capture_order)
            ordered.append(iter(rows))
        number = TaskContext.get().partitionId()
        merged = [(*row, number, i) for i, row in enumerate(LoserTree(ordered, capture_order))]
        out = pd.DataFrame(merged, columns=[*CAPTURES.names, "history_range", "history_position"])
        yield out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to", "offset", "history_range", "history_position")})

    schema = T.StructType([*CAPTURES.fields, T.StructField("history_range", T.LongType()), T.StructField("history_position", T.LongType())])
    return dealt.mapInPandas(merge, schema)


def archive_pages(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None, smallest: int = 0, archive_bytes: int = 16 << 20, level: int = 6, per_range: int = 50_000, broadcast_rows: int = 500_000
) -> DataFrame:
    """Writes every row as a WARC record, reads the archives back and returns all captures in global order.

    Columns: those of CAPTURES, history_range, history_position. ``payload`` is text (UTF-8) or binary, null as empty;
    ``captured`` is seconds after 2024 (the page_id where not given). Null URLs are stored as an empty target; a null
    page_id stays null and is a response only where no other page has its payload. Very long pages make a longer
    archive; an empty table makes no archive and no rows; other columns are not read. Digests are of whole payloads
    and are checked when the archives are read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("sha1", F.sha1("payload"))
    time = captured if captured is not None else F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9))
    folder = new_folder(spark, "warc")
    records = _decide(rows, smallest, broadcast_rows).withColumn("captured", time.cast("bigint")).sortWithinPartitions(F.col("page_id"), "revisit", "url")
    archives = write_archives(records, folder, archive_bytes, level)
    if archives.isEmpty():
        return spark.createDataFrame([], T.StructType([*CAPTURES.fields, T.StructField("history_range", T.LongType()), T.StructField("history_position", T.LongType())]))
    runs = written(read_runs(spark, folder), "runs")
    return merge_runs(runs, per_range, runs.count())
