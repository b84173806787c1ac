"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACES = (0x20, *range(0x09, 0x0E))
SLICE = 4 << 20  # bytes of text handled at once in a task, or one text
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**i (mod 2**64) for i below n."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int) -> int:
    """The number that gives 1 with an odd ``base`` (mod 2**64)."""
    return pow(base, -1, 1 << 64)


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))  # of each byte; A-Z count as a-z, spaces as nothing
_VALUE[65:91] = _VALUE[97:123]
_VALUE[list(SPACES)] = 0
# Value of each byte of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z taken as a-z, for ``word_table``; 0: between words.
ALNUM = np.where([chr(i).isalnum() and i < 128 or i > 127 for i in range(256)], _VALUE, 0).astype(np.uint64)
_BASE, _HIGH = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_LOW = powers(_BASE, 1 << 16)
_BLOCK = 1 << 18  # bytes or words whose powers are kept
_UP, _DOWN = powers(_BASE, _BLOCK + 1), powers(inverse(_BASE), _BLOCK + 1)


class Words(NamedTuple):
    """Words of a run of texts, A-Z taken as a-z: 64-bit hashes and places."""

    hash: np.ndarray  # uint64
    start: np.ndarray  # first byte of each word in ``data``
    end: np.ndarray  # byte after each word
    first: np.ndarray  # index of the first word of each text, and the number of words
    data: np.ndarray  # UTF-8 bytes of all texts
    text: np.ndarray  # first byte of each text, and the number of bytes


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_table(texts: pa.Array, value: np.ndarray = _VALUE) -> Words:
    """All words of an array of texts at once: runs of bytes with a value, ``[^\\x20\\x09-\\x0D]+`` if not told otherwise."""
    data, at = utf8(texts)
    word = np.zeros(len(data) + 2, bool)
    (value != 0).take(data, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    inner = np.unique(at[(at > 0) & (at < len(data))])
    inner = inner[word[inner] & word[inner + 1]]  # a word never crosses from one text into the next
    if len(inner):
        edges = np.sort(np.concatenate([edges, inner, inner]))
    start, end = edges[::2].copy(), edges[1::2].copy()
    hashes = np.empty(len(start), np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), _BLOCK >> 1)), [len(start)]]))
    with np.errstate(over="ignore"):
        for i, j in zip(cuts[:-1], cuts[1:]):
            s, lo, hi = start[i:j], start[i], end[j - 1]
            if hi - lo <= _BLOCK and (end[i:j] - s).max() <= len(_LOW):
                # Sums up to each byte, with powers from the block's first byte on; a word's own begin at its start.
                sums = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(value[data[lo:hi]] * _UP[:hi - lo], out=sums[1:])
                hashes[i:j] = (sums[end[i:j] - lo] - sums[s - lo]) * _DOWN[s - lo]
                continue
            place = np.arange(lo, hi) - np.repeat(s, np.diff(np.append(s, hi)))
            v = value[data[lo:hi]] * _LOW[place & 0xFFFF]
            if len(place) and place.max() >> 16:
                v *= powers(_HIGH, (int(place.max()) >> 16) + 1)[place >> 16]
            hashes[i:j] = np.add.reduceat(v, s - lo)
        hashes = mix(hashes + (end - start).astype(np.uint64))
    return Words(hashes, start, end, np.searchsorted(start, at), data, at)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring word hashes."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = _BLOCK - width
    with np.errstate(over="ignore"):
        if width < 6 or step < 1:
            for i, p in enumerate(powers(_BASE, width)):
                out += h[i:i + n] * p
            return mix(out)
        for i in range(0, n, step):
            j = min(i + step, n)
            sums = np.zeros(j - i + width, np.uint64)
            np.cumsum(h[i:j + width - 1] * _UP[:j - i + width - 1], out=sums[1:])
            out[i:j] = (sums[width:] - sums[:-width]) * _DOWN[:j - i]
    return mix(out)


def runs(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run h[start : start + size]; the runs are in order and do not overlap, none is empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = int(size.sum())
    at = np.cumsum(np.concatenate([[0], size[:-1]]))
    place = np.arange(n) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        v = h[np.repeat(start, size) + place] * powers(0x9E3779B97F4A7C15, int(size.max()))[place]
        return mix(np.add.reduceat(v, at) + size.astype(np.uint64))


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that their ``text`` holds ``size`` bytes, or one row."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b["text"].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        i, held = 0, 0
        for j, x in enumerate(n):
            if j > i and held + x > size:
                yield b.slice(i, j - i)
                i, held = j, 0
            held += int(x)
        if len(n) > i:
            yield b.slice(i, len(n) - i)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased (bytes split on just these spaces)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a folder of our own only on a local master where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/rebill-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark drops the shuffle files of a query when the query ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rebill-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected ``edges`` (a, b) that reach a smaller one: the smallest they reach.

    Union-find as rounds of hooking each root to its smallest neighbouring root, then pointer jumping. A node that is
    its own root has no row. Hot roots only meet joins with one row a key, which adaptive execution splits.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    parent = None
    while parent is None or not pairs.isEmpty():
        hook = stored(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = stored(hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
            dropped(hook)
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        old = parent
        if parent is None:
            parent = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            moved = parent.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            parent = stored(moved.unionByName(hook))
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = stored(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        dropped(pairs, *([old] if old is not None else []))
        pairs = left
    dropped(pairs)
    return parent


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
