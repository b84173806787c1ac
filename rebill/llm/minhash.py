"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification and union-find grouping.

Null, empty and blank texts have no shingles and link with nothing. Texts with fewer words than a shingle have their
whole sequence as one shingle. Equal sets are one class, so copies are never expanded into pairs. Every row is
returned; rows that repeat a doc_id are one document with several texts, which links wherever one of them does.
Rows with a null doc_id stand alone: component_id is null and kept is true.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import components, dropped, mix, read, rolled, runs, sliced, stored, word_table
from rebill.llm.linking import link

BANDS, ROWS = 40, 6  # a pair at 0.8 misses every band with a chance of 5e-6
CHUNK = 50_000  # shingles handled at once


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures [n, m] of n sets given as flat uint64 elements and their owners (ascending); m is at most 256.

    Each element draws a random permutation (a swap a round) and a fresh fraction a round; a slot keeps its least
    round + fraction. A set stops when every slot holds less than the next round.
    """
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(elements), CHUNK):
        el, own = elements[s:s + CHUNK], owner[s:s + CHUNK].astype(np.int64)
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(el), 1))
        rows = np.arange(len(el))
        for j in range(m):
            u = mix(el ^ mix(np.full(1, j + 1, np.uint64)))
            k = j + (u % np.uint64(m - j)).astype(np.int64)
            slot = perm[rows, k].copy()
            perm[rows, k] = perm[rows, j]
            value = (np.uint64(j) << np.uint64(40)) | (mix(u) >> np.uint64(24))
            np.minimum.at(best, own * m + slot, value)
            # Sets whose slots are all below the next round need no more of it.
            ids = own[np.concatenate([[True], own[1:] != own[:-1]])]
            full = best.reshape(n, m)[ids].max(axis=1) < (np.uint64(j + 1) << np.uint64(40))
            if full.all():
                break
            if full.any():
                done = np.zeros(n, bool)
                done[ids[full]] = True
                keep = ~done[own]
                el, own, rows = el[keep], own[keep], rows[keep]
    return best.reshape(n, m)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    w = word_table(texts)
    every = rolled(w.hash, width)
    out = []
    for i, j in zip(w.first[:-1], w.first[1:]):
        if j - i >= width:
            out.append(np.unique(every[i:j - width + 1]))
        else:
            out.append(runs(w.hash, np.array([i]), np.array([j - i])) if j > i else np.zeros(0, np.uint64))
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        out += np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
    return out


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests [2, set] of sets; 0 for empty ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, some = np.concatenate([np.zeros(0, np.uint64), *sets]), np.flatnonzero(sizes)
    out = np.zeros((2, len(sets)), np.int64)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            for k in (0, 1):
                out[k, some] = mix(np.add.reduceat(mix(flat ^ np.uint64(k + 1)), at) + sizes[some].astype(np.uint64)).view(np.int64)
    return out


def sign(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, null if empty), keys (a band)."""
    schema = "doc_id long, n_shingles long, node long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(b["text"], width)
            sizes = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), bands), np.int64)
            if len(some):
                sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(some)), sizes[some]), len(some), bands * rows)
                keys[some] = band_keys(sig, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32), keys.ravel())
            node = pa.array(_digests(sets)[0], mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes), node, lists], names=["doc_id", "n_shingles", "node", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """node and its set, of ``rows`` (node, text) whose text has the set that node is a digest of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(b["text"], width)
            node = b["node"].to_numpy()
            keep = np.flatnonzero(_digests(sets)[0] == node)
            ends = np.cumsum([0] + [len(sets[i]) for i in keep]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in keep]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.ListArray.from_arrays(ends, flat)], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(sign(docs, width))
    # A class of equal sets is named by its digest; its head is its smallest doc_id.
    one = signed.where("node is not null and doc_id is not null")
    heads = stored(one.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))
    member = heads.select("node", F.posexplode("keys").alias("no", "key")).select("node", F.xxhash64("no", "key").alias("bucket"))
    # A head has a bucket at most once, so a count tells whether others have it.
    twice = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    inside = stored(member.join(twice, "bucket"))
    # From here on nothing reads the keys, which are most of both tables.
    wide, keyed = signed, heads
    signed, heads = stored(wide.drop("keys")), stored(keyed.drop("keys"))
    one = signed.where("node is not null and doc_id is not null")
    dropped(wide, keyed)
    wanted = stored(inside.select("node").distinct().join(heads, "node"))
    sets = stored(_sets(docs.join(wanted, "doc_id"), width))
    roots = link(inside, sets, percent)
    dropped(inside, wanted, sets)
    # Texts of one doc_id are one document, so their classes are one.
    several = one.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    same = stored(one.select("doc_id", "node").join(several, "doc_id").where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct())
    if not same.isEmpty():
        roots = components(same.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    classes = stored(heads.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("least"))
    final = stored(classes.join(least, "root").select("node", "least"))
    out = signed.select("doc_id", "n_shingles", "node").join(final, "node", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "documents"), width=2, percent=80)
