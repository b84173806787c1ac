"""Substring dedup: MinHash banding of paragraphs, exact verification, removals by components.

A paragraph is a sentence or a line of a text. Paragraphs of MIN_PARAGRAPH words or more that share a band are linked where
the exact Jaccard of their word shingles reaches PERCENT; each component keeps its first occurrence by (doc_id,
position), others are repeated (in one document, only equal ones). A verified passage need not begin or end with a paragraph: windows of MIN_RUN
words that occur earlier are repeated wherever they begin, so of equal passages of MIN_RUN + SPACING - 1 words or more
only the first stays, be they cut in mid-sentence or made of short sentences. Runs of MIN_RUN repeated words or more are
cut, with shorter paragraphs that lie between repeated words.

Null texts stay null and empty ones empty. Places are (doc_id, word), so rows that repeat a doc_id do not repeat each
other, and of several texts each loses what it holds at its place. Rows with a null doc_id are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rebill.llm.common import SLICE, Words, dropped, mix, read, rolled, runs, sliced, stored, word_table
from rebill.llm.linking import link
from rebill.llm.minhash import band_keys

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 6, 2  # tuned for recall: a pair at 0.8 shares a band with a chance of 0.998
MIN_PARAGRAPH, MIN_RUN = 8, 25
SPACING = 16  # words between the chosen windows of a passage, at most
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the paragraphs of all texts: they end with a line, a text or a word that ends in . ! or ?"""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = _ENDS[w.data[w.end - 1]]
    lines = np.flatnonzero(w.data == 10)
    last[:-1] |= np.searchsorted(lines, w.start[1:]) > np.searchsorted(lines, w.end[:-1])
    last[w.first[1:][w.first[1:] > 0] - 1] = True
    start = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    return start, np.diff(np.append(start, n))


def _kept_paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, key) of the paragraphs of the least length; the key is a hash of their words."""
    start, size = paragraphs(w)
    long = size >= MIN_PARAGRAPH
    return start[long], size[long], runs(w.hash, start[long], size[long]).view(np.int64)


def signature(shingle: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """MinHash signatures [set, slot] of the sets shingle[at[i] : at[i + 1]], by one hash function a slot."""
    out = np.empty((len(at), slots), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(mix(np.arange(2, 2 * slots + 2, dtype=np.uint64)).reshape(slots, 2)):
            x = (shingle ^ b) * (a | np.uint64(1))
            out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
    return out


def _shingles(w: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat shingles of paragraphs and where those of each begin."""
    n = size - WIDTH + 1
    at = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(at, n) + np.repeat(start, n)
    return rolled(w.hash, WIDTH)[place], at


def _again(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a key stands at an earlier place of the same text."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    return out


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, pos (its first word), n (words), key, own (whether the text has it before), buckets of every paragraph of the least length.

    Buckets are those of its bands, for one paragraph a key of a slice of texts, else null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE >> 2):
            w = word_table(b["text"])
            start, size, key = _kept_paragraphs(w)
            if not len(key):
                continue
            doc = np.searchsorted(w.first, start, "right") - 1
            one = np.sort(np.unique(key, return_index=True)[1])
            flat, at = _shingles(w, start[one], size[one])
            bucket = band_keys(signature(flat, at, BANDS * ROWS), BANDS, ROWS).view(np.int64)
            some = np.zeros(len(key), bool)
            some[one] = True
            ends = np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, bucket.ravel(), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key), pa.array(_again(doc, key)), lists], names=["doc_id", "pos", "n", "key", "own", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, n int, key long, own boolean, buckets array<long>")


def _wanted_sets(rows: DataFrame) -> DataFrame:
    """node, set of the paragraphs that ``rows`` (text, wanted: their keys) want."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w = word_table(b["text"])
            start, size, key = _kept_paragraphs(w)
            one = np.unique(key, return_index=True)[1]
            one = np.sort(one[np.isin(key[one], b["wanted"].flatten().to_numpy())])
            sets = []
            if len(one):
                flat, at = _shingles(w, start[one], size[one])
                sets = [np.unique(x) for x in np.split(flat, at[1:])]
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.ListArray.from_arrays(ends, flat)], names=["node", "set"])

    return rows.select("text", "wanted").mapInArrow(run, "node long, set array<long>")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, pos, n: the paragraphs that are not the first of their component."""
    docs = docs.where("doc_id is not null and text is not null")
    places = stored(_places(docs))
    banded = places.where("buckets is not null").select(F.col("key").alias("node"), F.explode("buckets").alias("bucket"))
    mixed = stored(banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket"))
    inside = stored(banded.join(mixed, "bucket").select("bucket", "node").distinct())
    counts = stored(places.groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    wanted = inside.select("node").distinct().join(counts, "node").groupBy("doc_id").agg(F.collect_set("node").alias("wanted"))  # of one text
    sets = stored(_wanted_sets(docs.join(wanted, "doc_id")).dropDuplicates(["node"]))
    roots = link(inside, sets, PERCENT)
    classes = counts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = classes.groupBy("root").agg(F.min("doc_id").alias("first"), F.sum("n").alias("all")).where("all > 1").select("root", "first")
    keyed = stored(classes.join(tops, "root").select(F.col("node").alias("key"), "first"))
    out = stored(places.join(keyed, "key").where("own or doc_id > first").select("doc_id", "pos", "n"))
    dropped(places, mixed, inside, counts, sets, keyed)
    return out


def chosen(hs: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of the least hash of every SPACING neighbouring windows of each text; equal passages choose equal ones.

    first, last: of each text the first window and the place after its last; a text of fewer windows chooses one.
    """
    use = np.zeros(len(hs), bool)
    if len(hs) >= SPACING:
        low, width = np.arange(len(hs)), 1
        while width < SPACING:  # the least of two windows that overlap or touch, the left one if they are equal
            step = min(width, SPACING - width)
            left, right = low[:-step], low[step:]
            low, width = np.where(hs[left] <= hs[right], left, right), width + step
    for i, j in zip(first, last):
        if j - i >= SPACING:
            use[low[i:j - SPACING + 1]] = True
        elif j > i:
            use[i + hs[i:j].argmin()] = True
    return np.flatnonzero(use)


def _seeds(docs: DataFrame) -> DataFrame:
    """doc_id, hs, ps: hashes and places of the chosen windows of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w = word_table(b["text"])
            hs = rolled(w.hash, MIN_RUN)
            last = np.maximum(w.first[1:] - MIN_RUN + 1, w.first[:-1])
            at = chosen(hs, w.first[:-1], last)
            ends = np.searchsorted(at, w.first).astype(np.int32)
            doc = np.searchsorted(w.first, at, "right") - 1
            lists = [pa.ListArray.from_arrays(ends, x) for x in (hs[at].view(np.int64), (at - w.first[doc]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *lists], names=["doc_id", "hs", "ps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hs array<long>, ps array<int>")


def _near_windows(rows: DataFrame) -> DataFrame:
    """h, doc_id, pos, own of all windows fewer than SPACING words from those in ``hits`` of ``rows`` (doc_id, text, hits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w = word_table(b["text"])
            hs = rolled(w.hash, MIN_RUN)
            last = np.maximum(w.first[1:] - MIN_RUN + 1, w.first[:-1])
            of = np.repeat(np.arange(len(b)), pc.list_value_length(b["hits"]).to_numpy())
            at = b["hits"].flatten().to_numpy() + w.first[of]
            lo, hi = np.maximum(w.first[of], at - SPACING + 1), np.minimum(last[of], at + SPACING)
            edge = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(edge, lo, 1)
            np.add.at(edge, np.maximum(lo, hi), -1)
            at = np.flatnonzero(np.cumsum(edge)[:len(hs)] > 0)
            doc = np.searchsorted(w.first, at, "right") - 1
            h = hs[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), b["doc_id"].take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(_again(doc, h))], names=["h", "doc_id", "pos", "own"])

    return rows.select("doc_id", "text", "hits").mapInArrow(run, "h long, doc_id long, pos int, own boolean")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, n of windows that occur earlier, and of whole texts that do.

    Equal passages of MIN_RUN + SPACING - 1 words choose an equal window at least every SPACING words, so all their
    windows are near a chosen one that repeats; only these are compared one by one. Whole copies need no windows.
    """
    docs = docs.where("doc_id is not null and text is not null")
    ids = docs.select("doc_id", F.xxhash64("text").alias("th"))
    firsts = ids.groupBy("th").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("th", "first")
    copies = stored(ids.join(firsts, "th").where("doc_id > first").select("doc_id").distinct())
    lists = stored(_seeds(docs).join(copies, "doc_id", "left_anti"))
    twice = stored(lists.select(F.explode("hs").alias("h")).groupBy("h").count().where("count > 1").select("h"))
    seeds = lists.select("doc_id", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("doc_id", F.col("x.hs").alias("h"), F.col("x.ps").alias("pos"))
    hits = stored(seeds.join(twice, "h").groupBy("doc_id").agg(F.collect_list("pos").alias("hits")))  # bounded by one text
    dropped(lists, twice)
    dense = stored(_near_windows(docs.join(hits, "doc_id")))
    tops = dense.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h", "lo")
    n = F.lit(MIN_RUN).alias("n")
    later = stored(dense.join(tops, "h").where("doc_id > lo and not own").select("doc_id", "pos", n).unionByName(dense.where("own").select("doc_id", "pos", n)))
    dropped(hits, dense)
    return later.unionByName(copies.select("doc_id", F.lit(0).alias("pos"), F.lit(2147483647).alias("n")))


def cuts(w: Words, i: int, start: np.ndarray, gone: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) in text ``i`` of the runs to cut; start: of all paragraphs; gone: its repeated parts, place and words in one long."""
    lo, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
    edge = np.zeros(n + 1, np.int64)
    pos = np.minimum(gone >> 32, n)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(pos + (gone & 0xFFFFFFFF), n), -1)
    bad = np.cumsum(edge) > 0
    bad[n] = False
    pairs = np.flatnonzero(np.diff(bad.astype(np.int8), prepend=0)).reshape(-1, 2)
    joined: list[list[int]] = []
    for s, e in pairs.tolist():
        if joined and s - joined[-1][1] < MIN_PARAGRAPH:
            a, b = np.searchsorted(start, [joined[-1][1] + lo, s + lo])
            # Whole short paragraphs between repeated words go with them.
            if a < len(start) and start[a] == joined[-1][1] + lo and (b == len(start) or start[b] == s + lo):
                joined[-1][1] = e
                continue
        joined.append([s, e])
    return [(s, e) for s, e in joined if e - s >= MIN_RUN]


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed`` (words), ``spans`` (start, end in the text).

    Further columns are kept; columns of the names removed and spans are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "removed", "spans")]
    docs = docs.select("text", *rest).withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = repeated(docs).unionByName(repeated_windows(docs))
    held = "_gone"
    while held in rest:
        held += "_"
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias(held))  # bounded by one text
    rows = docs.join(gone, "doc_id", "left").select("text", held, *rest)
    schema = StructType([StructField("text", StringType()), *[StructField(c, docs.schema[c].dataType) for c in rest], StructField("removed", LongType()), StructField("spans", ArrayType(ArrayType(IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, removed, spans = b["text"].to_pylist(), [], []
            some = [i for i, g in enumerate(b[held].is_valid().to_pylist()) if g and texts[i]]
            w = word_table(b["text"].take(pa.array(some, pa.int64())))
            start, _ = paragraphs(w)
            found = {i: cuts(w, k, start, b[held][i].values.to_numpy()) for k, i in enumerate(some)}
            for k, i in enumerate(some):
                lo, hi, base, raw = w.first[k], w.first[k + 1], int(w.text[k]), w.data[w.text[k]:w.text[k + 1]].tobytes()
                # A cut takes the space after it, up to the next word or the end of the text.
                found[i] = [(int(w.start[lo + s]) - base if s else 0, int(w.start[lo + e]) - base if lo + e < hi else len(raw), e - s) for s, e in found[i]]
                out, at = [], 0
                for s, e, _ in found[i]:
                    out.append(raw[at:s])
                    at = e
                texts[i] = (b"".join(out) + raw[at:]).decode("utf-8")
                found[i] = [(len(raw[:s].decode("utf-8")), len(raw[:e].decode("utf-8")), n) for s, e, n in found[i]]
            for i in range(len(texts)):
                removed.append(sum(c[2] for c in found.get(i, [])))
                spans.append([[c[0], c[1]] for c in found.get(i, [])])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *[b[c] for c in rest], pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["text", *rest, "removed", "spans"])

    return rows.mapInArrow(run, schema)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", (F.col("removed") > 0).alias("repeats"), "removed", "spans", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
