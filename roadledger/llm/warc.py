"""WARC (5): a two-level capture index over WARC files.

Pages are written as WARC/1.0 response records, each a gzip member of its own, to files in the
shared folder. Index lines (key, page, file, offset, length, digest) are sorted by key over the
whole table and cut into compressed blocks; a sparse directory has the first and last key of each
block and its place. A lookup reads the part of the directory that its keys can be in, binary
searches it, reads the blocks' byte ranges, and then the records' byte ranges.

A key is the url with its host reversed (www. dropped, lower case), port unless 80 or 443, path,
and sorted query; scheme, user and fragment don't count. A url without :// is its own key.

Defined cases: a null url isn't indexed; null html is a record without payload, found with null
digest and size; pages with equal keys are captures of one key, numbered by page_id, however many
blocks they span; repeated rows are captures of their own; an unknown key has no rows; an empty table
gives an empty index and result; other columns are ignored. Files of failed task attempts stay
unreferenced in the folder.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadledger.llm import base

#: Keys that a task looks up: at least, to use the machines there are, and at most.
LEAST_KEYS, MOST_KEYS = 500, 50_000
#: Index lines of a block.
BLOCK_LINES = 1000
LEVEL = 3
LINE = "key string, page_id bigint, file string, offset bigint, length bigint, digest string"
ENTRY = "first_key string, last_key string, file string, offset bigint, length bigint, lines int"


def url_key(url: Column) -> Column:
    """The sort key of a url."""
    url = url.cast("string")
    low = F.lower(url)
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www[0-9]*\.", "")
    port = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    key = F.concat(
        F.array_join(F.reverse(F.split(host, r"\.")), ","),
        F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.lit(")"),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )
    return F.when(low.rlike(r"^[a-z][a-z0-9+.-]*://"), key).otherwise(url)


def _open(path: str, write: bool = False):
    """A file of the shared folder, whatever system it is on; reading can seek."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(place.rpartition("/")[0], recursive=True)
        return system.open_output_stream(place, compression=None)
    return system.open_input_file(place)


def record(page_id: int | None, url: str, source: str | None) -> bytes:
    """A WARC response record as a gzip member."""
    body = (source or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {target}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Payload-Digest: {digest(source) or 'none'}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + http + b"\r\n\r\n") + packer.flush()


def digest(source: str | None) -> str | None:
    return None if source is None else hashlib.md5(source.encode("utf-8", "surrogatepass")).hexdigest()


def payload(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of a record."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http = rest[: int(fields["Content-Length"])]
    return fields, http.partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(key, page_id, url, html) to index lines, with the records written on the way."""
    path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
    try:
        for batch in base.sized(batches, "html"):
            out = out or _open(path, write=True)
            offsets, lengths, digests = [], [], []
            for page_id, url, source in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = record(page_id, url, source)
                out.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                digests.append(digest(source))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([path] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], ["key", "page_id", "file", "offset", "length", "digest"])
    finally:
        if out:
            out.close()


def _blocks(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Sorted index lines to compressed blocks and their directory entries."""
    path, out, at, held, entries = f"{folder}/{uuid.uuid4().hex}.cdx.z", None, 0, [], []

    def block() -> None:
        nonlocal out, at
        out = out or _open(path, write=True)
        raw = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
        out.write(raw)
        entries.append((held[0][0], held[-1][0], path, at, len(raw), len(held)))
        at += len(raw)
        held.clear()

    try:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= lines:
                    block()
        if held:
            block()
    finally:
        if out:
            out.close()
    columns = list(zip(*entries)) or [[]] * 6
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first_key", "last_key", "file", "offset", "length", "lines"])


class Captures:
    """The index in a folder: a directory that is read by key range, and block files."""

    def __init__(self, directory: str):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(directory)
        self.entries = ds.dataset(place, filesystem=system, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."])
        self.lowest: list[str] = []
        self.highest: list[str] = []
        self.places: list[tuple] = []
        self.files: dict[str, object] = {}
        self.block: tuple[tuple, list, list[str]] | None = None

    def narrow(self, first: str, last: str) -> None:
        """Load the directory entries that keys from first to last can be in."""
        import pyarrow.dataset as ds

        found = self.entries.to_table(filter=(ds.field("first_key") <= last) & (ds.field("last_key") >= first)).to_pylist()
        found.sort(key=lambda e: (e["first_key"].encode("utf-8", "surrogatepass"), e["last_key"].encode("utf-8", "surrogatepass"), e["offset"]))
        self.lowest, self.highest = [e["first_key"].encode() for e in found], [e["last_key"].encode() for e in found]
        self.places = [(e["file"], e["offset"], e["length"]) for e in found]

    def read(self, file: str, offset: int, length: int) -> bytes:
        """A byte range."""
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.popitem()[1].close()
            self.files[file] = _open(file)
        return self.files[file].read_at(length, offset)

    def lines(self, key: str) -> Iterator[list]:
        """Index lines of a key, by binary search of the directory and of the blocks."""
        wanted = key.encode()
        k = bisect.bisect_left(self.highest, wanted)  # the first block that doesn't end before the key
        while k < len(self.places) and self.lowest[k] <= wanted:
            if self.block is None or self.block[0] != self.places[k]:
                rows = [json.loads(x) for x in zlib.decompress(self.read(*self.places[k])).decode().split("\n")]
                self.block = (self.places[k], rows, [r[0].encode() for r in rows])
            _, rows, keys = self.block
            for n in range(bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)):
                yield rows[n]
            k += 1

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def build(pages: DataFrame, lines: int = BLOCK_LINES) -> tuple[str, DataFrame]:
    """Write records, blocks and directory; (the directory's path, the index lines)."""
    spark = pages.sparkSession
    folder = base.scratch_path(spark, "warc")
    folder = folder if "://" in folder else "file://" + folder
    own = pages.where("url is not null").select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    captures = base.stash(base.mapped(own, lambda batches: _write(batches, folder), LINE), "captures")
    ordered = captures.repartitionByRange("key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", "page_id", "file", "offset")
    directory = f"{folder}/directory"
    base.mapped(ordered, lambda batches: _blocks(batches, folder, lines), ENTRY).where("lines > 0").write.parquet(directory)
    return directory, captures


def lookup(keys: DataFrame, directory: str) -> DataFrame:
    """Captures of every distinct `key`: the record is read back and checked against the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Captures(directory)
        try:
            for batch in batches:
                own = batch.column(0).to_pylist()
                if not own:
                    continue
                index.narrow(own[0], own[-1])
                out = []
                for key in own:
                    for _, page_id, file, offset, length, known in index.lines(key):
                        _, body = payload(index.read(file, offset, length))
                        found = None if known is None else hashlib.md5(body).hexdigest()
                        out.append((key, page_id, found, None if known is None else len(body), found == known))
                    if len(out) >= 2000:
                        yield _found(out)
                        out = []
                yield _found(out)
        finally:
            index.close()

    asked = keys.where("key is not null").select("key").distinct()
    many = asked.count()  # tasks by the reads they make: the keys alone are too few bytes to tell
    parts = max(1, -(-many // MOST_KEYS), min(-(-many // LEAST_KEYS), 4 * keys.sparkSession.sparkContext.defaultParallelism))
    return base.mapped(asked.repartitionByRange(parts, "key").sortWithinPartitions("key"), run, "key string, page_id bigint, digest string, n_bytes bigint, sound boolean")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "digest", "n_bytes", "sound"])


def captures(pages: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Every page looked up by its url: (page_id, key, capture, n_captures, digest, n_bytes, sound)."""
    directory, _ = build(pages, lines)
    found = lookup(pages.select(url_key(F.col("url")).alias("key")), directory)
    by_key = Window.partitionBy("key")
    return found.select("page_id", "key", F.row_number().over(by_key.orderBy("page_id", "digest")).alias("capture"), F.count("*").over(by_key).alias("n_captures"), "digest", "n_bytes", "sound")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(base.table(spark, sf_dir, "pages"))


ORACLE = {
    "op5_warc_index": r"""
WITH u AS (SELECT page_id, html, url, lower(url) AS low FROM pages WHERE url IS NOT NULL),
p AS (SELECT *, regexp_replace(regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www[0-9]*\.', '') AS host,
  regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1) AS port,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
k AS (SELECT page_id, html, CASE WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://') THEN array_to_string(list_reverse(string_split(host, '.')), ',')
  || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END ELSE url END AS key FROM p)
SELECT page_id, key, CAST(row_number() OVER (PARTITION BY key ORDER BY page_id, md5(html)) AS INTEGER) AS capture, count(*) OVER (PARTITION BY key) AS n_captures, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS n_bytes, true AS sound FROM k"""
}
QUERIES = {"op5_warc_index": op5_warc_index}
