"""Web archives: writing pages as WARC records, merging their capture index, reading the records back.

Writing. Of pages with equal payloads (SHA-1 and length) of `min_revisit_bytes` at least, the one with the largest
page_id becomes a response, the others become revisits of it. Every task writes one archive, each record a gzip
member of its own, and a run of the capture index. Tasks sort their pages by URL key and time first, so the run is
sorted as it is written, and no task holds more than a batch.

Merging. Runs are merged by loser trees with a bounded number of ways, in several rounds if there are more runs. The
last round splits the key space at sampled keys of the runs: each task merges one range of all runs, found by the
runs' sparse indexes. The ranges in order are the globally ordered capture history.

Reading. Records are read at the places that the merged index names, archive by archive, and their digests checked.

Files get their final name when they are complete, under names that depend on the partition only, so a task that
runs again replaces its own work. The folder must be one that pyarrow's file systems open on all nodes (a shared
path, s3, gs, hdfs).

Defined cases: a NULL html is an empty payload. A NULL url has the key `-`, a NULL page_id sorts first and never is
the one that others refer to, unless all of a group are NULL; of rows that share the largest page_id of a group all
are responses. Further columns are ignored. No rows: no rows and no files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keyspan.llm.common import settled, shared_folder


@dataclass(frozen=True)
class Archive:
    """Limits of revisits and of the merge."""

    min_revisit_bytes: int = 0
    ways: int = 256
    lines_a_range: int = 20_000
    most_ranges: int = 2_000
    block_lines: int = 256
    salts: int = 16


EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key() -> Column:
    """The URL with its host's parts from the general to the special, without scheme, www and fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    rest = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.col("url").isNull(), "-").otherwise(F.regexp_replace(key, r"[\t\r\n]", " "))


def with_record_types(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """page_id, url, html, digest, type, refers_to, key and at (seconds) for each row of `pages`."""
    # A page holds no time of capture; its number stands for the seconds since an epoch.
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("bytes"),
        url_key().alias("key"),
        F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)).cast("long").alias("at"),
    )
    kept = (
        rows.where(F.col("bytes") >= archive.min_revisit_bytes)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper"))
        .where("copies > 1")
        .select("digest", "bytes", "keeper", F.lit(True).alias("shared"))
    )
    # Any one payload may be that of a third of all pages: its rows are spread over the salts.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(archive.salts)).cast("int"))
    spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(archive.salts - 1))))
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return salted.join(spread, ["digest", "bytes", "salt"], "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
        "key",
        "at",
    )


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, kind: str, refers_to: int | None, at: int) -> bytes:
    """One WARC record; a revisit keeps the headers of the response but not its payload."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    identity = lambda number: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{number}')}>"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", identity(page_id)),
        ("WARC-Date", (EPOCH + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", identity(refers_to)),
            ("Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page, size and digest of the payload, type and reference, from one record; a wrong digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if real != digest or size != len(payload):
            raise ValueError(f"record of page {fields['Page-ID']} is damaged")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {
        "page_id": number("Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID"),
    }


def _zipped(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Output:
    """A file that gets its name when it is closed well."""

    def __init__(self, folder: str, name: str):
        self.system, path = pafs.FileSystem.from_uri(folder)
        self.final = f"{path}/{name}"
        self.draft = f"{path}/.{name}-{uuid.uuid4().hex}"
        self.system.create_dir(path, recursive=True)
        self.stream = self.system.open_output_stream(self.draft, compression=None)
        self.place = 0

    def write(self, data: bytes) -> int:
        place = self.place
        self.stream.write(data)
        self.place += len(data)
        return place

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.final)


class _Run:
    """A sorted run of index lines and its sparse index (first key and place of each block)."""

    def __init__(self, folder: str, name: str, block_lines: int):
        self.lines, self.sparse = _Output(folder, name + ".cdx"), _Output(folder, name + ".idx")
        self.block_lines, self.count = block_lines, 0

    def add(self, line: list) -> None:
        place = self.lines.write((json.dumps(line) + "\n").encode())
        if self.count % self.block_lines == 0:
            self.sparse.write((json.dumps([*line[:3], place]) + "\n").encode())
        self.count += 1

    def close(self) -> None:
        self.lines.close()
        self.sparse.close()


def _key(line: list) -> tuple:
    # URL key by bytes, time, page (-1: none).
    return (line[0].encode("utf-8", "surrogatepass"), line[1], line[2])


def _read_lines(folder: str, name: str, place: int = 0) -> Iterator[list]:
    system, path = pafs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as raw:
        raw.seek(place)
        rest = b""
        while data := raw.read(1 << 16):
            *whole, rest = (rest + data).split(b"\n")
            yield from map(json.loads, whole)


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, so a new line plays along one path only."""

    def __init__(self, runs: list[Iterator[list]], key: Callable[[list], tuple] = _key):
        self.runs, self.key, self.n = runs, key, max(1, len(runs))
        self.heads: list[tuple | None] = [None] * self.n
        self.lines: list[list | None] = [None] * self.n
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [-1] * self.n
        self.winner = -1
        for i in range(self.n):
            self._enter(i)

    def _advance(self, i: int) -> None:
        line = next(self.runs[i], None)
        self.lines[i], self.heads[i] = line, None if line is None else self.key(line)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and self.heads[a] is not None
        return (self.heads[a], a) < (self.heads[b], b)

    def _enter(self, i: int) -> None:
        """First matches: a contestant waits at the first free node, or plays on."""
        node = (i + self.n) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[list]:
        while self.lines and self.heads[self.winner] is not None:
            i = self.winner
            yield self.lines[i]
            self._advance(i)
            node = (i + self.n) // 2
            while node:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def write_archives(pages: DataFrame, folder: str, archive: Archive = Archive()) -> DataFrame:
    """Writes the archives and index runs; one settled row (run, records) for each."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}"
        out = run = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        out, run = _Output(folder, name + ".warc.gz"), _Run(folder, "run-0-" + name, archive.block_lines)
                    payload = row["html"].encode("utf-8", "surrogatepass")
                    raw = record(row["page_id"], row["url"], payload, row["digest"], row["type"], row["refers_to"], row["at"])
                    data = _zipped(raw)
                    place = out.write(data)
                    page = -1 if row["page_id"] is None else row["page_id"]
                    run.add([row["key"], row["at"], page, name + ".warc.gz", place, len(data)])
        if out is not None:
            out.close()
            run.close()
            yield pa.RecordBatch.from_arrays([pa.array(["run-0-" + name]), pa.array([run.count])], ["run", "records"])

    rows = with_record_types(pages, archive).withColumn("page", F.coalesce("page_id", F.lit(-1)))
    return settled(rows.sortWithinPartitions("key", "at", "page").drop("page").mapInArrow(write, "run string, records bigint"))


def merge_index(runs: DataFrame, folder: str, archive: Archive = Archive()) -> DataFrame:
    """The capture index in global order, by range: range, position, key, at, page, file, place, length."""
    spark = runs.sparkSession
    level = 0
    while runs.count() > archive.ways:
        # More runs than ways: each task merges some of them into one.
        level += 1

        prefix = f"run-{level}-part-"

        def merge_some(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            names, name = sorted(frame["run"]), f"{prefix}{int(key[0]):06d}"
            run = _Run(folder, name, archive.block_lines)
            for line in LoserTree([_read_lines(folder, n + ".cdx") for n in names]):
                run.add(line)
            run.close()
            return pd.DataFrame({"run": [name], "records": [run.count]})

        # Run names are few, at most one for each task of the writing job.
        names = sorted(r["run"] for r in runs.select("run").collect())
        numbered = spark.createDataFrame([(i // archive.ways, n) for i, n in enumerate(names)], "batch long, run string")
        runs = settled(numbered.groupBy("batch").applyInPandas(merge_some, "run string, records bigint"))

    described = runs.agg(F.sum("records"), F.sort_array(F.collect_list("run"))).first()
    total, names = described[0] or 0, described[1]
    ranges = max(1, min(archive.most_ranges, total // archive.lines_a_range))
    schema = "range bigint, position bigint, key string, at bigint, page bigint, file string, place bigint, length bigint"

    def first_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("run").to_pylist():
                own = list(_read_lines(folder, name + ".idx"))
                # Evenly spaced keys of the run, as many as there are ranges: enough to split evenly.
                own = own[:: max(1, len(own) // (2 * ranges))]
                columns = [pa.array([o[0] for o in own], pa.string()), *(pa.array([o[i] for o in own], pa.int64()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "at", "page"])

    keys = runs.select("run").mapInArrow(first_keys, "key string, at bigint, page bigint")
    cuts: list[tuple] = []
    if ranges > 1:
        tiles = keys.select(F.ntile(ranges).over(_by_key()).alias("tile"), "key", "at", "page")
        # One key for each range: at most `most_ranges`.
        firsts = tiles.groupBy("tile").agg(F.min(F.struct("key", "at", "page")).alias("k")).where("tile > 1").collect()
        cuts = sorted(_key([r.k.key, r.k.at, r.k.page]) for r in firsts)

    def merge_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("range").to_pylist():
                low = cuts[number - 1] if number else None
                high = cuts[number] if number < len(cuts) else None

                def part(name: str, low: tuple | None = low, high: tuple | None = high) -> Iterator[list]:
                    place = 0
                    if low is not None:
                        blocks = list(_read_lines(folder, name + ".idx"))
                        at = bisect.bisect_left([_key(b) for b in blocks], low)
                        place = blocks[max(0, at - 1)][3]
                    for line in _read_lines(folder, name + ".cdx", place):
                        if high is not None and _key(line) >= high:
                            return
                        if low is None or _key(line) >= low:
                            yield line

                run = _Run(folder, f"index-{number:06d}", archive.block_lines)
                held: list[list] = []
                for line in LoserTree([part(n) for n in names]):
                    held.append([number, run.count, *line])
                    run.add(line)
                    if len(held) == 4096:
                        yield _rows(held)
                        held = []
                run.close()
                if held:
                    yield _rows(held)

    def _rows(lines: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["range", "position", "key", "at", "page", "file", "place", "length"]
        columns = [pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    tasks = spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).withColumnRenamed("id", "range")
    return settled(tasks.mapInArrow(merge_range, schema))


def _by_key() -> WindowSpec:
    return Window.orderBy("key", "at", "page")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row for each record that the index names, read from its archive."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        name, archive = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                for row in batch.slice(at, 1024).to_pylist():
                    if row["file"] != name:
                        if archive is not None:
                            archive.close()
                        name, archive = row["file"], system.open_input_file(f"{path}/{row['file']}")
                    archive.seek(row["place"])
                    rows.append(parse_record(zlib.decompress(archive.read(row["length"]), 31)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
        if archive is not None:
            archive.close()

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    # A stated number, as adaptive execution would merge the small index rows of many large archives into one task.
    readers = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "place", "length").repartition(readers, "file").sortWithinPartitions("file", "place")
    return placed.mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Writes `pages` as archives in the shared folder, merges their index, and reads every record back."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = ("file://" if folder.startswith("/") else "file:///") + folder.removeprefix("file:")
    runs = write_archives(pages, folder, archive)
    return read_archives(merge_index(runs, folder, archive), folder)
