"""WARC archives: write, read back, and merge sorted capture runs into capture histories.

1. Digests decide record types on slim rows: of equal payloads of at least ``LEAST_BYTES`` bytes the smallest page id is a response
   and the others revisit it. A hot digest is pre-aggregated, and the join back, by page id and digest, is on slim rows.
2. Each task writes archives of one gzip member a record, of at most ``ARCHIVE_BYTES``, into the shared folder. File names
   are unique to the attempt, and only files that a finished task reports are read: a retried task leaves nothing behind that counts.
3. Each archive is read back from its first byte to its last, digests are verified, and its captures are sorted by URL key (host
   labels reversed), time and page id into a run: a Parquet file of small row groups.
4. Runs are merged through a loser tree, ``FAN_IN`` at a time, in passes if there are more. Every merge, that of an intermediate pass too, is cut into
   ranges of the key space (about ``RANGE_ROWS`` captures) at quantiles of a bounded sample of keys, time and page id included, so one URL that makes a third of all
   captures is cut as well. A range is a task; it reads only the parts of runs, and in them the row groups, that overlap it by the whole key, and holds one of each run.
   A merged run is a list of such parts. A part offers at most ``MOST_CUTS`` keys as cuts.

Pages carry no time: a capture's time is the start of 2024 plus as many seconds as the page id. Defined results: a null html is an empty payload. Rows with a null
page id are left out; every other row gives one record, those that repeat an id too: each is judged by its own payload, and rows with the smallest page id of a payload are all responses. Null urls
have an empty key; control characters and spaces of urls are percent-encoded. Ties in key and time are ordered by page id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import chain, islice

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import arrow_map, load, new_path, partitions, table

LEAST_BYTES, ARCHIVE_BYTES, FAN_IN, GROUP_ROWS, RANGE_ROWS = 100, 16 << 20, 64, 2048, 100_000
#: Every so many-th capture of a part is offered as a cut (fewer where that is more than ``MOST_CUTS``), and so many of them are looked at for a merge.
CUT_EVERY, MOST_CUTS, CUTS_SEEN = 256, 1024, 20_000
#: Names that Hadoop's connectors and pyarrow give one store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
ORDER = ("url_key", "captured", "page_id")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to``, the page that a row of ``page_id, url, html`` revisits, or null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha2(payload, 256))
    slim = rows.where(F.octet_length(payload) >= LEAST_BYTES).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to")
    later = slim.join(firsts, "digest").where("page_id > refers_to").distinct()
    return rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def encoded_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def url_key(url: str) -> str:
    """Host labels reversed, then the rest: ``com,example,www)/a?b``. Port and user are dropped, A-Z of the host is folded."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0]
    return ",".join(reversed(host.encode().lower().decode().split("."))) + ")" + rest[cut:].partition("#")[0]


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member that holds one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    date = EPOCH + timedelta(seconds=page_id % 4_000_000_000)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        *([f"WARC-Target-URI: {encoded_url(url)}"] if url else []),
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def members(source, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, read in pieces."""
    inflate, body, data = None, [], b""
    while data or (data := source.read(step)):
        if inflate is None:
            inflate, body = zlib.decompressobj(31), []
        body.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(body)
            inflate = None
    if inflate is not None:
        raise ValueError("an archive ends within a record")


def _header_lines(part: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = part.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in rest)}


def parse(body: bytes) -> tuple[tuple, bytes | None]:
    """A record's capture row and, for a response, its payload; raises ``ValueError`` where the record contradicts itself."""
    head, _, rest = body.partition(b"\r\n\r\n")
    version, fields = _header_lines(head)
    n = int(fields["content-length"])
    if not version.startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    _, http_fields = _header_lines(http)
    size, digest = int(http_fields["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest or length")
    number = lambda name: int(fields[name].removeprefix("<urn:page:").removesuffix(">"))
    refers_to = number("warc-refers-to") if kind == "revisit" else None
    row = (url_key(fields.get("warc-target-uri", "")), fields["warc-date"], number("warc-record-id"), size, digest, kind, refers_to)
    return row, payload if kind == "response" else None


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    uri = SCHEMES.get(scheme, scheme) + mark + rest
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_task(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id, url, (html or "").encode(), refers_to)
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, name], None
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return run


def write_run(fs: pa.fs.FileSystem, path: str, rows: Iterator[tuple], cut_every: int = CUT_EVERY) -> tuple[int, list[tuple], tuple | None, tuple | None]:
    """Rows in order as a Parquet file of small row groups; returns their number, the offered cuts, and the first and last key."""
    n, cuts, held, first, last = 0, [], [], None, None
    with fs.open_output_stream(path) as sink, pq.ParquetWriter(sink, CAPTURE, compression="zstd") as writer:

        def flush() -> None:
            columns = list(zip(*held)) or [[] for _ in CAPTURE]
            writer.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, CAPTURE)], schema=CAPTURE))
            held.clear()

        for row in rows:
            last = row[:3]
            first = first or last
            if n % cut_every == 0:
                cuts.append(last)
                if len(cuts) > MOST_CUTS:
                    cuts, cut_every = cuts[::2], 2 * cut_every
            held.append(row)
            n += 1
            if len(held) == GROUP_ROWS:
                flush()
        flush()
    return n, cuts, first, last


KEY = pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64())])
KEY_SQL = "struct<url_key:string,captured:string,page_id:long>"
PART = f"run string, part int, file string, n long, cuts array<{KEY_SQL}>, first {KEY_SQL}, last {KEY_SQL}"


def _part_batch(run: str, part: int, file: str, n: int, cuts: list[tuple], first: tuple | None, last: tuple | None) -> pa.RecordBatch:
    named = lambda key: key and dict(zip(ORDER, key))
    columns = [pa.array([run]), pa.array([part], pa.int32()), pa.array([file]), pa.array([n], pa.int64()), pa.array([[named(c) for c in cuts]], pa.list_(KEY)), pa.array([named(first)], KEY), pa.array([named(last)], KEY)]
    return pa.RecordBatch.from_arrays(columns, names=["run", "part", "file", "n", "cuts", "first", "last"])


def _sort_task(folder: str, cut_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    rows = sorted((parse(body)[0] for body in members(source)), key=lambda r: r[:3])
                made = f"run-{uuid.uuid4().hex}.parquet"
                yield _part_batch(made, 0, made, *write_run(fs, f"{root}/{made}", iter(rows), cut_every))

    return run


def group_bounds(group: pq.RowGroupMetaData) -> tuple[tuple, tuple]:
    """The least and the largest key of an ordered row group, as far as its statistics tell: a column's bounds hold within one value of those before it."""
    least, most = (), ()
    for i in range(3):
        stats = group.column(i).statistics
        if stats is None or not stats.has_min_max:
            break
        least, most = (*least, stats.min), (*most, stats.max)
        if stats.min != stats.max:
            break
    return least, most


def run_rows(fs: pa.fs.FileSystem, path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The rows of a part from ``low`` up to, not including, ``high``, a row group at a time."""
    with fs.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        for g in range(file.metadata.num_row_groups):
            least, most = group_bounds(file.metadata.row_group(g))
            if (low and most < low[: len(most)]) or (high and least > high[: len(least)]):
                continue
            for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns)):
                if (not low or row[:3] >= low) and (not high or row[:3] < high):
                    yield row


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, and the winner's leaf replays
    only its path to the root."""

    def __init__(self, sources: list[Iterator[tuple]], key: Callable[[tuple], tuple] = lambda r: r[:3]):
        self.sources, self.key = sources, key
        self.k = len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [key(h) if h is not None else None for h in self.heads]
        self.losers = [-1] * max(self.k, 1)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = head = next(self.sources[w], None)
            self.keys[w] = self.key(head) if head is not None else None
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_plan(parts: DataFrame, groups: DataFrame, cut_every: int, range_rows: int) -> DataFrame:
    """``g, r, low, high, sources``: the ranges of every group's keys and the parts of its runs that overlap each. ``groups``: run, g."""
    spark = parts.sparkSession
    own = parts.where("n > 0").join(groups, "run")
    wanted = F.expr(f"greatest(1L, least({partitions(spark)}L, cast(ceil(n / {4 * cut_every}) as bigint)), n div {range_rows})")
    sizes = own.groupBy("g").agg(F.sum("n").alias("n")).select("g", wanted.alias("wanted"))
    by_hash = Window.partitionBy("g").orderBy(F.xxhash64("c"), "c")
    seen = own.select("g", F.explode("cuts").alias("c")).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= CUTS_SEEN)
    listed = seen.groupBy("g").agg(F.array_sort(F.collect_list("c")).alias("c")).join(sizes, "g")
    cuts = listed.select("g", F.expr("array_distinct(if(wanted > 1, transform(sequence(1L, wanted - 1), i -> get(c, cast(i * size(c) div wanted as int))), slice(c, 1, 0)))").alias("c"))
    none = F.array(F.lit(None).cast(KEY_SQL))
    ends = F.arrays_zip(F.concat(none, "c").alias("low"), F.concat("c", none).alias("high"))
    ranges = cuts.select("g", F.posexplode(ends).alias("r", "b")).select("g", "r", "b.low", "b.high")
    overlap = own.select("g", "run", "part", "file", "first", "last").join(ranges, "g").where("(low is null or last >= low) and (high is null or first < high)")
    return overlap.groupBy("g", "r", "low", "high").agg(F.array_sort(F.collect_list(F.struct("run", "part", "file"))).alias("sources")).select("g", "r", "low", "high", "sources")


def _merged(fs: pa.fs.FileSystem, root: str, row: dict) -> Iterator[tuple]:
    low, high = (row[k] and tuple(row[k][c] for c in ORDER) for k in ("low", "high"))
    runs: dict[str, list[str]] = {}
    for source in row["sources"]:
        runs.setdefault(source["run"], []).append(source["file"])
    return iter(LoserTree([chain.from_iterable(run_rows(fs, f"{root}/{f}", low, high) for f in files) for files in runs.values()]))


def _merge_pass_task(folder: str, cut_every: int):
    """A range of a group becomes a part of its merged run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                made = f"run-{uuid.uuid4().hex}.parquet"
                yield _part_batch(f"merged-{row['g']}", row["r"], made, *write_run(fs, f"{root}/{made}", _merged(fs, root, row), cut_every))

    return run


def _merge_last_task(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                merged, place = _merged(fs, root, row), 0
                while held := list(islice(merged, GROUP_ROWS)):
                    columns, n = [pa.array(c, f.type) for c, f in zip(zip(*held), CAPTURE)], len(held)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([row["r"]] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], names=[*CAPTURE.names, "merge_range", "merge_place"])
                    place += n

    return run


def capture_histories(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, fan_in: int = FAN_IN, cut_every: int = CUT_EVERY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes the archives, reads them back and returns all captures in global order of ``merge_range, merge_place``."""
    spark = pages.sparkSession
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    folder = new_path(spark, "warc")
    archives = table(arrow_map(with_record_types(rows), _write_task(folder, archive_bytes), "file string"), "archives")
    parts = table(arrow_map(archives.repartition(max(1, archives.count())), _sort_task(folder, cut_every), PART), "runs")

    def tasks(groups: DataFrame) -> DataFrame:
        """One partition for each range."""
        plan = table(merge_plan(parts, groups, cut_every, range_rows), "ranges")
        return plan.repartition(max(1, plan.count()))

    while (n_runs := parts.select("run").distinct().count()) > fan_in:
        # Equal shares of the runs: the order of names, all that is sorted here, is as good as any.
        numbered = parts.select("run").distinct().select("run", (F.ntile(-(-n_runs // fan_in)).over(Window.orderBy("run")) - 1).alias("g"))
        parts = table(arrow_map(tasks(numbered), _merge_pass_task(folder, cut_every), PART), "runs")
    # Written, so that the plan joins on the group; on a constant it would be a product.
    last = tasks(table(parts.select("run").distinct().withColumn("g", F.lit(0)), "groups"))
    schema = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, merge_range int, merge_place long"
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "merge_range", "merge_place")
    return arrow_map(last, _merge_last_task(folder), schema).select(*columns)


def with_global_place(histories: DataFrame) -> DataFrame:
    """Instead of range and place in it, ``place`` among all captures: the ranges' sizes, one row each, are added up."""
    merged = table(histories, "merged")
    sizes = merged.groupBy("merge_range").agg(F.count("*").alias("n"))
    starts = sizes.select("merge_range", (F.sum("n").over(Window.orderBy("merge_range")) - F.col("n")).alias("start"))
    placed = merged.join(starts, "merge_range")
    return placed.withColumn("place", F.col("start") + F.col("merge_place")).drop("merge_range", "merge_place", "start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_global_place(capture_histories(load(spark, sf_dir, "pages")))


SQL = """
with p as (select page_id, coalesce(url, '') as u, encode(coalesce(html, '')) as body from pages where page_id is not null),
d as (select page_id, u, octet_length(body) as n, sha256(body) as digest from p),
f as (select *, min(page_id) over (partition by digest) as least from d),
h as (select *, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else u end as rest from f),
k as (select *, regexp_extract(rest, '^[^/?#]*', 0, 's') as host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1, 's') as tail from h),
c as (select page_id, n::bigint as payload_bytes, digest as payload_digest, case when n >= 100 and page_id > least then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id > least then least end as refers_to,
  case when u = '' then '' else array_to_string(list_reverse(string_split(regexp_replace(translate(regexp_replace(host, '^.*@', '', 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':.*$', '', 's'), '.')), ',') || ')' || tail end as url_key,
  strftime(timestamp '2024-01-01' + to_seconds(page_id % 4000000000), '%Y-%m-%dT%H:%M:%SZ') as captured from k)
select *, row_number() over (order by url_key, captured, page_id) - 1 as place from c
"""
