"""WARC archives of pages and one globally ordered capture index, merged from sorted runs.

Archives are written as record members (gzip) in a Parquet table of the shared folder: the members of an archive
joined in order of ``offset`` are the bytes of its ``.warc.gz`` file. Spark's own writer commits them, so the loss of an
executor costs a task and never half an archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import pickle
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.storage import materialise, pages

EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, the capture of page 0; page n follows n (modulo 10**9) seconds later


#: Host, path and query of a URL with a scheme; user and port are passed over.
URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?")


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the right, then path and query, in lower case.

    Null gives the empty key, and what is no URL stands for itself without outer blanks.
    """
    parts = URL.match((url or "").strip(" "))
    if not parts:
        return (url or "").strip(" ").lower()
    host, path, query = parts.groups("")
    return (",".join(reversed(host.lower().removeprefix("www.").split("."))) + ")" + (path or "/") + query).lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of an equal payload, still with the payload.

    Identical-payload revisits may carry their block; here they do, so that each archive can be read by itself.
    """
    when = datetime.fromtimestamp(EPOCH + (page_id or 0) % 1_000_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = re.sub(r"[\r\n]", "", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class LoserTree:
    """Merge of k sorted runs: inner nodes keep the loser of each match, so a new winner costs log2(k) comparisons."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _head(self, run: int) -> tuple:
        row = self.at[run]
        return (0, self.runs[run][row], run) if row < len(self.runs[run]) else (1, (), run)

    def _play(self, run: int, building: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = run
                return
            if self._head(other) < self._head(run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        while self.k:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._play(run)


def winners(table: DataFrame, hot_share: int = 1000) -> DataFrame:
    """``refers_to`` by payload: the largest page_id with an equal payload, null for that record itself.

    Repeated rows of one page_id are all the response, and of rows without an id none is. Digests of more than one
    row in ``hot_share`` are fewer than that, so their winners are broadcast and their rows stay where they are; all
    others meet their winner by a join of evenly small keys.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = table.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    last = materialise(keyed.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") > max(1, table.count() // hot_share)
    marked = keyed.join(F.broadcast(last.where(hot).select("digest", F.col("last").alias("hot_last"), F.lit(True).alias("hot"))), "digest", "left")
    # rows that have their winner get keys of their own, which spread
    marked = marked.withColumn("key", F.when(F.col("hot"), F.concat(F.lit("#"), F.xxhash64("page_id", "url"))).otherwise(F.col("digest")))
    joined = marked.join(last.where(~hot).select(F.col("digest").alias("key"), "last"), "key", "left")
    found = F.coalesce("hot_last", "last")
    return joined.select("page_id", "url", "html", F.when(found.isNotNull() & (F.col("page_id").isNull() | (found != F.col("page_id"))), found).alias("refers_to"))


def write_archives(records: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """``(archive, offset, member)``: gzip record members; an archive ends after ``archive_bytes``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, offset = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                out: list[tuple[str, int, bytes]] = []
                for page, url, html, ref in zip(*(c.to_pylist() for c in whole.slice(row, 512).columns), strict=True):
                    payload = html.encode()
                    member = gzip.compress(make_record(page, url, payload, digest32(payload), ref), 1, mtime=0)
                    if offset + len(member) > archive_bytes and offset:
                        number, offset = number + 1, 0
                    out.append((f"{part:06d}-{number:05d}", offset, member))
                    offset += len(member)
                a, b, c = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["archive", "offset", "member"])

    return records.mapInArrow(write, "archive string, offset long, member binary")


def read_archives(members: DataFrame) -> DataFrame:
    """One row a record, from the stored bytes alone; the payload digest is computed again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url_key", "ts", "page_id", "archive", "offset", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                out = []
                for archive, offset, member in zip(*(c.to_pylist() for c in whole.slice(row, 512).columns), strict=True):
                    f, payload = read_record(gzip.decompress(member))
                    ts = int(datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    page, ref = f["WARC-Record-ID"][10:-1], f.get("WARC-Refers-To")
                    out.append((url_key(f["WARC-Target-URI"]), ts, None if page == "None" else int(page), archive, offset, len(payload), digest32(payload), f["WARC-Type"], int(ref[10:-1]) if ref else None))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return members.mapInArrow(read, "url_key string, ts long, page_id long, archive string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def merged_index(captures: DataFrame, range_rows: int = 100_000, run_rows: int = 100_000) -> DataFrame:
    """Captures with ``index_range`` and ``capture_rank``, the place from 0 in the global order.

    The order is that of (URL key, timestamp, page_id, archive, offset), null ids first. Every task sorts the captures it
    reads into runs of ``run_rows`` and cuts each run at range bounds; the task of a range receives its piece of every run
    packed in one row and merges the pieces with a loser tree. Bounds are quantiles of a sample of the whole sort key, so
    captures of one URL or host that hold a third of the rows spread over many ranges; every capture is in exactly one
    range. There is a range for each ``range_rows`` captures, so a range does not grow with the corpus; few captures still
    make 64 ranges. One bound a range comes to the driver.
    """
    n = captures.count()
    ranges = max(1, min(64, n // 1000), n // range_rows)
    key = F.struct("url_key", "ts", F.col("page_id").isNull().alias("unnumbered"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "archive", "offset")
    bounds: list[tuple] = []
    if ranges > 1:
        drawn = captures.sample(min(1.0, 32 * ranges / n), seed=7).select(key.alias("key"))
        placed = drawn.select("key", F.row_number().over(Window.orderBy("key")).alias("place"), F.count("*").over(Window.partitionBy()).alias("of"))
        step = F.floor(F.col("place") * ranges / F.col("of"))
        bounds = sorted(tuple(r["key"]) for r in placed.where(step > F.floor((F.col("place") - 1) * ranges / F.col("of"))).where("place < of").select("key").collect())
    names = captures.columns

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut() -> Iterator[pa.RecordBatch]:
            held.sort()
            keys = [r[0] for r in held]
            edges = [0, *(bisect.bisect_left(keys, b) for b in bounds), len(keys)] if len(bounds) < len(keys) else None
            part = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) if edges else np.array([bisect.bisect_right(bounds, k) for k in keys])
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(at, np.append(at[1:], len(keys)), strict=True):
                yield pa.record_batch([pa.array([part[a]], pa.int32()), pa.array([b - a], pa.int64()), pa.array([pickle.dumps(held[a:b])], pa.binary())], ["part", "n", "run"])
            held.clear()

        for batch in batches:
            held += (((r[0], r[1], r[2] is None, r[2] or 0, r[3], r[4]), r[5:]) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= run_rows:
                yield from cut()
        if held:
            yield from cut()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pieces = sorted((pickle.loads(r) for r in table.column("run").to_pylist()), key=lambda p: p[0][0])
        rows = [(*k[:2], None if k[2] else k[3], *k[4:], *v, key[0].as_py(), i) for i, (k, v) in enumerate(LoserTree(pieces))]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "index_range", "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema)
    merged = materialise(captures.mapInArrow(runs, "part int, n long, run binary").groupBy("part").applyInArrow(merge, schema + ", index_range long, place long"))
    # one row a range, whatever the number of captures
    sizes = merged.groupBy("index_range").agg(F.count("*").alias("size"))
    before = sizes.select("index_range", (F.sum("size").over(Window.orderBy("index_range")) - F.col("size")).alias("before"))
    return merged.join(F.broadcast(before), "index_range").select(*names, "index_range", (F.col("before") + F.col("place")).alias("capture_rank"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back, and placed in one global order of captures; one row a page.

    Null html is an empty payload, a null URL the empty key; an empty table gives no rows. Of equal keys and times, null ids
    come last. Repeated rows are archived each for itself.
    """
    table = pages(spark, sf_dir)
    members = materialise(write_archives(winners(table)))
    captures = materialise(read_archives(members))
    return merged_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("ts").alias("capture_ts"), "capture_rank")
