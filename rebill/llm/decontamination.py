"""Benchmark decontamination: an FM-index of each shard of training text, searched backwards for benchmark windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z taken as a-z. A window is ``width`` neighbouring words of an
item, or all words of a shorter one. Null and empty texts have no words; items without words have no window; windows
of an item without item_id mark words but name no item; rows of one item_id are one item. Every row of the documents is
returned, also repeated and null doc_ids; other columns are not looked at. An occurrence never crosses documents.

A shard is a slice of a task's rows. Its symbols are the words that any window holds; every other word and every border
of a document is a separator, which no window can cross, so nothing that could match is left out. Benchmarks of more
than ``BLOCK`` words take several passes, so that what tasks get is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import ALNUM, dropped, read, sliced, stored, word_table

WIDTH = 10  # words a window
BLOCK = 1 << 18  # words of items handled in a pass
SAMPLE = 16  # words between sampled suffix positions
ROW = "doc_id long, n_words long, n_hit long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols in which each 0 is a separator of its own, less than all words and than later separators.

    Ranks are the first places of groups; rounds double the compared length for the groups that are still tied.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_ = text[order]
    start = np.arange(n)
    fresh = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (sorted_[1:] == 0)])
    group = np.maximum.accumulate(np.where(fresh, start, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~fresh
    tied[:-1] |= tied[1:].copy()
    at, step = np.flatnonzero(tied), 1
    while len(at):
        own = order[at]
        key = rank[own] * n + rank[own + step]  # a tied suffix has ``step`` words, and a separator or more behind them
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[at] = own
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))
        tied = ~fresh
        tied[:-1] |= tied[1:].copy()
        at, step = at[tied], step * 2
    return order


class Bits:
    """A bit vector with the number of ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, p: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[p >> 6] + np.bitwise_count(self.words[p >> 6] & low)

    def __getitem__(self, p: np.ndarray) -> np.ndarray:
        return (self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FmIndex:
    """Backward search and location over symbols 1..sigma; 0 separates. All calls take arrays of questions."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        order = suffixes(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])  # rows before each symbol
        column = text[order - 1]  # the symbol before each suffix; that of the first is a separator
        column[order == 0] = 0
        kept = (order % sample == 0) | (column == 0)  # a walk stops before it meets a separator
        self.sampled, self.places = Bits(kept), order[kept]
        self.levels: list[tuple[int, int, Bits]] = []
        for bit in reversed(range(max(1, int(sigma).bit_length()))):
            ones = (column >> bit & 1).astype(bool)
            self.levels.append((bit, int(len(ones) - ones.sum()), Bits(ones)))
            column = np.concatenate([column[~ones], column[ones]])
        self.base = np.zeros(sigma + 1, np.int64)
        self.base = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        for bit, zeros, bits in self.levels:
            ones = bits.rank(p)
            p = np.where(symbol >> bit & 1, zeros + ones, p - ones)
        return p

    def rank(self, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place p of the column."""
        return self._down(symbol, p) - self.base[symbol]

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of the suffixes that begin with each window (a row of symbols)."""
        lo, hi = self.first[windows[:, -1]].copy(), self.first[windows[:, -1] + 1].copy()
        for j in range(windows.shape[1] - 2, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = windows[live, j]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows, walked back to the nearest sampled one."""
        out, left, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.places[self.sampled.rank(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            p, symbol = at, np.zeros(len(at), np.int64)
            for bit, zeros, bits in self.levels:
                one, ones = bits[p], bits.rank(p)
                symbol |= one.astype(np.int64) << bit
                p = np.where(one, zeros + ones, p - ones)
            at = self.first[symbol] + p - self.base[symbol]
            steps += 1
        return out


class Phrases:
    """Distinct windows of a block of items: their words as ids (from 1), and the set of items of each window."""

    def __init__(self, names: list[str | None], texts: list[str | None], width: int) -> None:
        w = word_table(pa.array(texts, pa.large_string()), ALNUM)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        by: dict[tuple[int, ...], set[str]] = {}
        for name, i, j in zip(names, w.first[:-1].tolist(), w.first[1:].tolist()):
            own = (ids[i:j] + 1).tolist()
            n = min(width, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                by.setdefault(tuple(own[k:k + n]), set()).update([] if name is None else [name])
        sets: dict[tuple[str, ...], int] = {}
        lengths: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for win, found in by.items():
            lengths.setdefault(len(win), []).append((win, sets.setdefault(tuple(sorted(found)), len(sets))))
        self.windows = [(np.array([x[0] for x in g]), np.array([x[1] for x in g])) for g in lengths.values()]
        self.sets = list(sets)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary & np.uint64((1 << 20) - 1)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words; 0 of those in no window."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == hashes[some], at + 1, 0)
        return out


def _blocks(items: DataFrame, width: int, size: int) -> Iterator[Phrases]:
    """The items in turn, ``size`` words at once; a longer item is cut into pieces that share width - 1 words."""
    names: list[str | None] = []
    texts: list[str | None] = []
    held = 0
    for name, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        w = word_table(pa.array([text], pa.large_string()), ALNUM)
        n = len(w.hash)
        for i in range(0, max(n - width + 1, 1), size):
            j = min(i + size + width - 1, n)
            if held and held + j - i > size:
                yield Phrases(names, texts, width)
                names, texts, held = [], [], 0
            names.append(name)
            texts.append(bytes(w.data[w.start[i]:w.end[j - 1]]).decode() if n else None)
            held += j - i
    yield Phrases(names, texts, width)


def _search(texts: pa.Array, phrases: Phrases, before: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, list[list[dict]], list[set[str]]]:
    """Of each text: words, words hit, spans, items; ``before`` has the spans of earlier blocks."""
    w = word_table(texts, ALNUM)
    docs = len(w.first) - 1
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(docs)]
    symbols = phrases.symbols(w.hash) if len(phrases.vocabulary) else np.zeros(len(w.hash), np.int64)
    # Borders of documents stand as separators between words; of neighbouring separators one is enough.
    text = np.insert(symbols, w.first, 0)
    word = np.insert(np.arange(len(symbols)), w.first, -1)
    kept = np.concatenate([[True], (text[1:] > 0) | (text[:-1] > 0)])
    text, word = text[kept], word[kept]
    if text.any():
        index = FmIndex(text, len(phrases.vocabulary))
        for windows, named in phrases.windows:
            lo, hi = index.find(windows)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            at = word[index.locate(lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            doc = np.searchsorted(w.first, at, side="right") - 1
            for pair in np.unique(doc * len(phrases.sets) + named[which]).tolist():
                items[pair // len(phrases.sets)].update(phrases.sets[pair % len(phrases.sets)])
    for d, spans in enumerate(before):
        for s in spans:
            cover[w.first[d] + s["first"]] += 1
            cover[w.first[d] + s["last"] + 1] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    begins = np.union1d(np.flatnonzero(edge == 1), w.first[:-1][hit[np.minimum(w.first[:-1], len(hit) - 1)]] if len(hit) else [])
    begins = begins[begins < len(hit)].astype(np.int64)
    stops = np.union1d(np.flatnonzero(edge == -1), begins)
    ends = stops[np.searchsorted(stops, begins, side="right")] if len(begins) else begins
    spans: list[list[dict]] = [[] for _ in range(docs)]
    owner = np.searchsorted(w.first, begins, side="right") - 1
    for d in np.unique(owner).tolist():
        letters = np.concatenate([[0], np.cumsum((w.data[w.text[d]:w.text[d + 1]] & 0xC0) != 0x80)])
        for a, b in zip(begins[owner == d].tolist(), ends[owner == d].tolist()):
            f = int(w.first[d])
            spans[d].append({"first": a - f, "last": b - 1 - f, "start": int(letters[w.start[a] - w.text[d]]), "end": int(letters[w.end[b - 1] - w.text[d]])})
    return np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]], spans, items


def _passed(docs: DataFrame, phrases: Phrases, first: bool, last: bool) -> DataFrame:
    schema = ROW + ("" if last else ", text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, hit, spans, items = _search(b["text"], phrases, [[]] * len(b) if first else b["spans"].to_pylist())
            if not first:
                items = [a | set(o) for a, o in zip(items, b["items"].to_pylist())]
            kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))
            out = [b["doc_id"], pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "spans", "items"]
            yield pa.RecordBatch.from_arrays(out + ([] if last else [b["text"]]), names=names + ([] if last else ["text"]))

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items (sorted ids) of every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Spans are joined runs of hit words: first and last word, and code points from start to before end.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held, old = None, None
    for phrases in _blocks(items, width, block):
        if held is not None:
            was, out = old, stored(_passed(out, held, old is None, False))
            if was is not None:
                dropped(was)
            old = out
        held = phrases
    return _passed(out, held, old is None, True)


def without(text: Column | str, spans: Column | str) -> Column:
    """The text without the code points of its spans."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, s: F.struct(
        F.concat(a["out"], cut(a["at"], s["start"])).alias("out"), s["end"].alias("at")))
    return F.concat(done["out"], cut(done["at"], F.length(text)))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least({WIDTH}, len(ws)) AS k, array_to_string(ws[i:i + least({WIDTH}, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - least({WIDTH}, len(ws)) + 2)) AS i FROM it WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, item, i, k FROM dw JOIN win USING (k, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
