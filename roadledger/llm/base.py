"""What the text operators share: scratch tables, sized Arrow chunks and fast word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_ROWS = 500
#: Rows up to which a side is broadcast; beyond, the join is left to a shuffle.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="roadledger-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there and lost executors don't matter."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is checked to be small, otherwise as it is."""
    limit = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, for rows as long as documents.

    Spark's default of 10,000 rows a batch would hold tens of MB of text in the JVM and again in
    the worker; a session that still has it gets `BATCH_ROWS`. Results don't depend on it.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def sized(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // limit
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def normalise(texts: pa.Array) -> pa.Array:
    """Lower case; each run of other characters than letters and digits is one space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """White-space words of each text: (offsets, codes, distinct words). A null text has none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, coded.dictionary


def characters(words: pa.Array, left: str = "", right: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, each between left and right, and their offsets."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + len(left) + len(right)
    joint = (right + left).join(words.to_pylist())
    text = (left + joint + right) if len(words) else ""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def hash_strings(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    points, offsets = characters(words, "\x02")
    if not len(words):
        return np.empty(0, np.uint64)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    longest = int(place.max()) + 1
    powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
    return mix64(np.add.reduceat(mix64(points.astype(np.uint64) + np.uint64(1)) * powers[place], offsets[:-1]))


def grams(words: pa.Array, orders: Iterable[int], bits: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word between boundary marks: (slots, word), sorted by word if ordered."""
    points, offsets = characters(words, "\x02", "\x03")
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = np.repeat(np.arange(len(words)), np.diff(offsets))
    left = offsets[1:][own] - np.arange(len(points))
    value, slots, place = np.zeros(len(points), np.uint64), [], []
    for n in range(1, max(orders) + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in orders:
            at = np.flatnonzero(left[: len(value)] >= n)
            slots.append((mix64(value[at]) >> np.uint64(64 - bits)).astype(np.int64))
            place.append(own[at])
    word = np.concatenate(place)
    if not ordered:
        return np.concatenate(slots), word
    order = np.argsort(word, kind="stable")
    return np.concatenate(slots)[order], word[order]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
