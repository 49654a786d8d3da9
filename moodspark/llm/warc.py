"""WARC archives of captures and an external merge of their index.

``write_archives`` writes one gzip member per record: a response with the payload,
or a revisit that refers to the record with the same payload. ``read_archives``
reads the files back, record by record; every file gives a locally sorted run of
index entries. ``merge_runs`` deals the runs out by ranges of (URL key, timestamp,
id) and merges the runs of a range with a loser tree, so that ranges in order and
entries in a range are the globally ordered capture histories.

A range has about ``range_rows`` entries whatever the skew, because its bounds are
full keys: a URL with a third of all captures spans many ranges. The bounds come
from a bounded sample of keys and decide balance only.

Archives go through pyarrow's own file systems where it has one for the scheme, else
through libhdfs, which opens whatever the cluster's Hadoop can.

A null payload is an empty one; a null URL is the empty URL; a null timestamp is
the epoch, and one outside the years 1 to 9999, which a WARC date can't hold, is the
nearest that can. Ids are any 64-bit integers. Payloads are text, stored as UTF-8.
Captures that repeat an id are records of their own; where their payloads differ,
each may refer to the one with its payload that has the smallest id, if that is
another id. Captures without an id are left out. An empty table writes no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import bound_batches, grown, materialise, scratch, smallest_of_key, table

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
GZIP_LEVEL = 4
READ_BYTES = 1 << 20
#: Bytes of archive after which a task starts another file.
FILE_BYTES = 256 << 20
FOLDER = "urn:capture:"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Microseconds since the epoch of the first and last moment that a date can name.
EARLIEST, LATEST = ((datetime(*at, tzinfo=UTC) - EPOCH) // timedelta(microseconds=1) for at in ((1, 1, 1), (9999, 12, 31, 23, 59, 59, 999_999)))
#: The query's stand-in for capture times: seconds from the epoch to the year 2100, which ids are folded into.
QUERY_SECONDS = 4_102_444_800


def url_key(url: str) -> str:
    """The host's labels in reverse order and the path, lower-cased, as capture indexes sort them."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
    except ValueError:
        return f")/{url.lower()}"
    if not parts.netloc:
        return f")/{url.lower()}"
    host = parts.netloc.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", name).split(".")))
    query = f"?{parts.query.lower()}" if parts.query else ""
    return f"{labels}{colon if port not in ('', '80', '443') else ''}{port if port not in ('', '80', '443') else ''}){parts.path.lower() or '/'}{query}"


def stamp(micros: int) -> str:
    """A WARC date, with a fraction where there is one."""
    moment = EPOCH + timedelta(microseconds=min(max(micros, EARLIEST), LATEST))
    return moment.isoformat().removesuffix("+00:00") + "Z"


def moment_of(date: str) -> int:
    """Microseconds since the epoch of a WARC date."""
    return (datetime.fromisoformat(date) - EPOCH) // timedelta(microseconds=1)


def record_bytes(key: int, url: str, micros: int, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record: version, headers, an HTTP head and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    block = http + payload if refers is None else http
    heads = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{FOLDER}{key}>"),
        ("WARC-Date", stamp(micros)),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers is not None:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{FOLDER}{refers}>")]
    heads.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{a}: {b}\r\n" for a, b in heads), "\r\n"]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in line)
    return {a.strip().lower(): b.strip() for a, b in pairs}


class Unzipped:
    """A file of gzip members as one stream that knows where members begin."""

    def __init__(self, raw) -> None:
        self.raw, self.buffer, self.read_so_far = raw, b"", 0

    def member(self) -> tuple[int, int, bytes] | None:
        """(offset, length, content) of the next member."""
        offset = self.read_so_far
        if not self.buffer:
            self.buffer = self.raw.read(READ_BYTES)
            if not self.buffer:
                return None
        press, parts = zlib.decompressobj(31), []
        while True:
            parts.append(press.decompress(self.buffer))
            if press.eof:
                self.read_so_far += len(self.buffer) - len(press.unused_data)
                self.buffer = press.unused_data
                return offset, self.read_so_far - offset, b"".join(parts)
            self.read_so_far += len(self.buffer)
            self.buffer = self.raw.read(READ_BYTES)
            if not self.buffer:
                raise ValueError(f"archive ends inside the record at {offset}")


def open_store(path: str):
    """The file system of a path and the path in it."""
    if not re.match(r"\w+:", path):
        path = f"file://{path}"
    scheme, _, rest = path.partition("://")
    try:
        return pa.fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid:
        host, _, inner = rest.partition("/")
        return pa.fs.HadoopFileSystem(f"{scheme}://{host}"), f"/{inner}"


def with_targets(captures: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``digest`` and ``refers``: the smallest id with an equal payload of at least ``least`` bytes, null for that id itself.

    Payloads are not shuffled for the comparison, only ids and digests. A payload with very many
    copies meets a partial minimum first, and only digests that repeat are joined back.
    """
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    rows = captures.withColumn("digest", F.unhex(F.sha2(payload, 256)))
    heads = rows.where(F.octet_length(payload) >= least).select("id", "digest")
    repeats = smallest_of_key(heads, "digest", "id").where(F.col("smallest") != F.col("id"))
    return rows.join(grown(repeats.groupBy("id", "digest").agg(F.min("smallest").alias("refers"))), ["id", "digest"], "left")


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write (id, url, micros, payload, refers) rows; the result lists the files with their records.

    Every task writes files under names of its own, so an attempt that fails leaves files that no list names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        sink = name = None
        written = records = 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for key, url, micros, payload, refers in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if sink is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    sink, written, records = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = (payload or "").encode("utf-8", "surrogatepass")
                press = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                raw = press.compress(record_bytes(key, url or "", micros or 0, data, hashlib.sha256(data).hexdigest(), refers)) + press.flush()
                sink.write(raw)
                written += len(raw)
                records += 1
                if written > FILE_BYTES:
                    sink.close()
                    done.append((name, written, records))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, written, records))
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "bytes", "records"])

    bound_batches(captures.sparkSession)
    # The list is written, so the files are written once.
    return materialise(captures.select("id", "url", "micros", "payload", "refers").mapInArrow(run, "file string, bytes long, records long"), "archives")


ENTRY = "run string, seq long, url_key string, micros long, id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
ARROW = {"string": pa.string(), "long": pa.int64()}
KINDS = [ARROW[c.split()[1]] for c in ENTRY.split(", ")]


def entry_of(offset: int, length: int, content: bytes, file: str) -> tuple:
    """The index entry of one record. A response's payload is measured and digested anew."""
    end = content.index(b"\r\n\r\n")
    heads = headers(content[:end])
    block = content[end + 4 : end + 4 + int(heads["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    digest = heads["warc-payload-digest"].removeprefix("sha256:")
    size = int(headers(block[:http_end])["content-length"])
    if heads["warc-type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record at {offset} of {file}")
    number = lambda name: int(heads[name][1:-1].removeprefix(FOLDER)) if name in heads else None
    return url_key(heads["warc-target-uri"]), moment_of(heads["warc-date"]), number("warc-record-id"), heads["warc-type"], number("warc-refers-to"), size, digest, file, offset, length


def read_archives(files: DataFrame, folder: str, run_rows: int = 200_000) -> DataFrame:
    """Index entries of the listed archives as locally sorted runs of at most ``run_rows`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)

        def sorted_run(entries: list[tuple], name: str) -> pa.RecordBatch:
            entries.sort(key=lambda e: e[:3])
            rows = [(name, seq, *e) for seq, e in enumerate(entries)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=COLUMNS)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                entries: list[tuple] = []
                turn = 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as raw:
                    stream = Unzipped(raw)
                    while (member := stream.member()) is not None:
                        entries.append(entry_of(*member, file))
                        if len(entries) >= run_rows:
                            yield sorted_run(entries, f"{file}#{turn}")
                            entries, turn = [], turn + 1
                if entries:
                    yield sorted_run(entries, f"{file}#{turn}")

    bound_batches(files.sparkSession)
    tasks = max(1, files.count())
    return files.select("file").repartition(tasks, "file").mapInArrow(run, ENTRY)


class LoserTree:
    """Merges k sorted sequences: inner nodes hold the losers, so the next winner costs one path of matches."""

    END = (1,)

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _pull(self, i: int) -> tuple:
        if i >= len(self.runs):
            return self.END
        entry = next(self.runs[i], None)
        # Real keys start with 0, so an exhausted run loses every match; the run's number breaks ties.
        return self.END if entry is None else (0, entry[0], i, entry)

    def _build(self, node: int) -> int:
        """Play the matches below a node; its winner."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        heads, losers = self.heads, self.losers
        while heads[self.winner] is not self.END:
            i = self.winner
            yield heads[i][3]
            heads[i] = self._pull(i)
            node = (i + self.k) // 2
            while node:
                if heads[losers[node]] < heads[i]:
                    losers[node], i = i, losers[node]
                node //= 2
            self.winner = i


def merge_runs(entries: DataFrame, range_rows: int = 100_000, sample_rows: int = 200_000) -> DataFrame:
    """The globally ordered histories: entries with ``range`` and ``place`` in it.

    ``sample_rows`` keys at most are looked at for the bounds of ranges, which affect balance only.
    """
    count = entries.count()
    ranges = max(1, -(-count // range_rows))
    bounds: list[tuple] = []
    if ranges > 1:
        keys = entries.select("url_key", "micros", "id").where(F.pmod(F.xxhash64("url_key", "micros", "id"), F.lit(max(1, count // sample_rows))) == 0)
        sample = sorted((r[0], r[1], r[2]) for r in keys.limit(2 * sample_rows).collect())
        bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    schema = "range long, place long, " + ENTRY

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, k) for k in keys], pa.int64()), *batch.columns], names=["range", *COLUMNS])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("run", "ascending"), ("seq", "ascending")])
        keys = list(zip(*(group.column(c).to_pylist() for c in ("url_key", "micros", "id")), strict=True))
        names = group.column("run").to_pylist()
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        stops = [*starts[1:], len(names)]
        runs = [((keys[i], i) for i in range(a, b)) for a, b in zip(starts, stops, strict=True)]
        order = [i for _, i in LoserTree(runs)]
        merged = group.take(pa.array(order, pa.int64()))
        return pa.table([merged.column("range"), pa.array(range(len(order)), pa.int64()), *(merged.column(c) for c in COLUMNS)], names=["range", "place", *COLUMNS])

    return entries.mapInArrow(dealt, "range long, " + ENTRY).groupBy("range").applyInArrow(merge, schema)


def capture_histories(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Write (id, url, micros, payload) captures, read the archives back and merge the index."""
    spark = captures.sparkSession
    folder = folder or scratch(spark, "warc")
    files = write_archives(with_targets(captures), folder)
    return merge_runs(materialise(read_archives(files, folder), "runs"))


def op1_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages``, read back from the archives in the order of the merged index."""
    pages = table(spark, sf_dir, "pages").where(F.col("page_id").isNotNull())
    captures = pages.select(F.col("page_id").cast("long").alias("id"), "url", (F.pmod(F.col("page_id").cast("long"), F.lit(QUERY_SECONDS)) * 1_000_000).alias("micros"), F.col("html").alias("payload"))
    return capture_histories(captures).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
