"""WARC archives of captures, and a globally ordered capture index by external merge.

Every task writes its captures to an archive of its own, each record a gzip member, and notes (URL key, time, place) in
runs that it sorts itself. The runs are then dealt out by ranges of the key, and in each range a loser tree merges its
pieces of the sorted runs, so that the index as a whole is in order of URL key and time. Whatever reads the index, reads
its files as they lie: records come back in that order, and a prefix of URLs is found by the files' own statistics.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_store, integer_key, sorted_runs, stored

#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 1000
#: Captures of a sorted run.
RUN = 20_000
#: Entries of a range of the index that is merged in one task, and of a run's piece that are open at a time.
RANGE, OPEN = 65_536, 1024
#: Repeated payloads up to which their list (about 100 bytes each) is sent to every task; beyond that, rows are shuffled.
SENT = 200_000
#: Archives that a reading task keeps open.
HANDLES = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "url_key string, captured long, page_id long, file string, offset long, length long, record_type string"
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the right, then path and query; without scheme, port and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed. A revisit has the HTTP header only."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:capture:{name}>",
        f"WARC-Date: {(datetime(1970, 1, 1) + timedelta(seconds=captured)).isoformat()}Z",
        *([f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A")] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record, and its payload (None for a revisit) and the payload's size."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    fields["payload_bytes"] = size
    return fields


def _captures(df: DataFrame, key: str, url: str, html: str, captured: str | None) -> DataFrame:
    """Columns page_id, url, captured, html, digest and refers_to for each row.

    Only digests are grouped. Payloads stay where they are, unless more than SENT of them are repeated.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    by_id = F.lit(1_577_836_800) + F.pmod(F.coalesce(F.col(key), F.lit(0)).cast("long"), F.lit(315_360_000))
    at = F.coalesce(F.col(captured).cast("long"), by_id) if captured else by_id
    at = F.greatest(F.least(at, F.lit(253_402_300_799)), F.lit(-62_135_596_800))
    digest = F.unhex(F.sha1(payload.cast("binary")))
    rows = df.select(integer_key(df, key).alias("page_id"), F.col(url).cast("string").alias("url"), at.alias("captured"), payload.alias("html"), digest.alias("digest"))
    long = F.octet_length("html") >= LEAST_REVISIT
    many = rows.filter(long).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).filter("n > 1 and original is not null").select("digest", "original")
    many = stored(many, "originals")
    other = F.when(long & ~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))
    found = lambda rows: rows.select("page_id", "url", "captured", "html", "digest", other.alias("refers_to"))
    if many.count() <= SENT:
        return found(rows.join(F.broadcast(many), "digest", "left"))
    short = rows.filter(~long).withColumn("original", F.lit(None).cast("long"))  # these refer to nothing and stay where they are
    return found(rows.filter(long).join(many.hint("shuffle_hash"), "digest", "left").unionByName(short))


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None) -> DataFrame:
    """Write a record for each row of ``df`` to gzip archives in ``folder``; returns the sorted runs of their index.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least LEAST_REVISIT bytes the one
    with the largest id is the response and the others are revisits that refer to it; smaller ones are all responses.
    Rows that repeat the largest id are each a response; a row with a null id is a revisit where a row with an id has its
    payload. ``captured`` names a column with the time in seconds since 1970, held within the years 1 to 9999; without it,
    or where it is null, captures are a second apart by id within ten years from 2020 on. A null URL leaves the header
    out and sorts first. The id column has to be of an integer type. Columns of other names are not looked at.

    The runs are a stored table with the columns of INDEX and run, pos: rows of one run are in order by pos.
    """
    rows = _captures(df, key, url, html, captured)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, path = file_store(folder)
        store.create_dir(path, recursive=True)
        name = f"capture-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        entries: list[tuple] = []
        runs = 0

        def run() -> pa.RecordBatch:
            nonlocal runs, entries
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[4]))
            columns = list(zip(*entries))
            label = f"{name} {runs}"
            runs, n = runs + 1, len(entries)
            entries = []
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))), pa.array([label] * n), pa.array(range(n))], [*_NAMES, "run", "pos"])

        out = None
        offset = 0
        whole_name, draft = f"{path}/{name}", f"{path}/.{name}.part"  # an attempt that is lost leaves no archive, only a draft
        try:
            for whole in batches:
                for first in range(0, whole.num_rows, 200):
                    for r in whole.slice(first, 200).to_pylist():
                        if out is None:
                            out = store.open_output_stream(draft, compression=None)
                        raw = gzip.compress(_record(r["page_id"], r["url"], r["captured"], r["html"].encode(), r["digest"], r["refers_to"]), 6, mtime=0)
                        out.write(raw)
                        entries.append((url_key(r["url"]), r["captured"], r["page_id"], name, offset, len(raw), "response" if r["refers_to"] is None else "revisit"))
                        offset += len(raw)
                        if len(entries) == RUN:
                            yield run()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(draft, whole_name)
        if entries:
            yield run()

    return stored(rows.mapInArrow(write, f"{INDEX}, run string, pos long"), "runs")


class LoserTree:
    """Merge of sorted sequences: each inner node keeps the loser of its match, so the next winner takes one way up."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = len(runs)
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        """Winner below a node; leaves are the nodes from k on."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._before(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _entries(piece: list[pa.RecordBatch], first: int) -> Iterator[tuple]:
    """(key, time, id, place) of a run's piece in order, ``first`` being its place; OPEN of them are made at a time."""
    for batch in piece:
        for start in range(0, batch.num_rows, OPEN):
            part = batch.slice(start, OPEN)
            for entry in zip(*(part.column(c).to_pylist() for c in ("url_key", "captured", "page_id"))):
                yield entry[0], entry[1], (entry[2] is not None, entry[2] or 0), first
                first += 1


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index: the runs' rows in order of (url_key, captured, page_id), over partitions and within them.

    A range has about RANGE entries at most, whatever their number, and is held as Arrow batches. Ranges are cut by file
    and place as well, so entries that repeat a key, time and id, all of those without a URL and id for instance, are
    dealt out over several.
    """
    total = runs.count()
    ranges = max(-(-total // RANGE), min(-(-total // 2048), 2 * runs.sparkSession.sparkContext.defaultParallelism), 1)
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "offset").sortWithinPartitions("run", "pos")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = [], []
        for _, fresh, batch in sorted_runs(batches, ["run"]):
            if fresh:
                pieces.append([])
            pieces[-1].append(batch)
            held.append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held).select(_NAMES).combine_chunks()
        starts = np.cumsum([0, *(sum(b.num_rows for b in p) for p in pieces)]).tolist()
        order = np.fromiter((entry[3] for entry in LoserTree([_entries(p, first) for p, first in zip(pieces, starts)])), np.int64, table.num_rows)
        for first in range(0, len(order), 10_000):
            yield from table.take(pa.array(order[first : first + 10_000])).combine_chunks().to_batches()

    return ranged.mapInArrow(merge, INDEX)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url, html) of the records that the index names.

    They come in the order of the index's files, which are read as they lie; of 500 entries at a time, those of one archive
    are read from front to back.
    The digest is bare lower-case hex SHA-1. A response's digest and size are checked against its payload. A revisit has
    the size and digest of the full payload from its headers, and null html.
    """
    def record(file: pa.NativeFile, offset: int, length: int) -> tuple:
        file.seek(offset)
        fields = parse_record(zlib.decompress(file.read(length), 31))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = fields["payload"]
        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != fields["payload_bytes"]):
            raise ValueError(f"record at {offset}: payload and headers differ")
        ids = [None if (x := fields.get(h)) is None or x == "<urn:capture:null>" else int(x[13:-1]) for h in ("WARC-Record-ID", "WARC-Refers-To")]
        return ids[0], fields["payload_bytes"], digest, fields["WARC-Type"], ids[1], fields.get("WARC-Target-URI"), None if payload is None else payload.decode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_store(folder)
        opened: dict[str, pa.NativeFile] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                part = whole.slice(first, 500).to_pylist()
                out: list[tuple | None] = [None] * len(part)
                for k in sorted(range(len(part)), key=lambda k: (part[k]["file"], part[k]["offset"])):
                    name = part[k]["file"]
                    if name not in opened:
                        if len(opened) >= HANDLES:
                            opened.pop(next(iter(opened))).close()
                        opened[name] = store.open_input_file(f"{path}/{name}")
                    out[k] = record(opened[name], part[k]["offset"], part[k]["length"])
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])
        for file in opened.values():
            file.close()

    return index.select("file", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def archive(df: DataFrame, folder: str, **columns) -> DataFrame:
    """Write ``df`` to archives in ``folder``, merge their runs, and return the index, a stored table in order."""
    return stored(merge_runs(write_archives(df, folder, **columns)), "index")


def captures(spark: SparkSession, index: DataFrame, prefix: str) -> DataFrame:
    """Capture history of the URLs whose key begins with ``prefix``, in order.

    As the index's files are in order, Parquet's statistics leave out all but those that can hold the prefix; what they
    hold of it is put in order again, as Spark reads files side by side.
    """
    return index.filter(F.col("url_key").startswith(prefix)).orderBy("url_key", "captured", "page_id")
