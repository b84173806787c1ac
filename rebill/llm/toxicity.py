"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated modified Kneser-Ney model of word pairs, each counted once a document:
its pair counts are discounted and back off to its continuation counts (how many different words stand before a
word), which are discounted and back off to those that both classes share, so a rare expression weighs what both know
of it. The log-likelihood ratio, toxic against ordinary, is normalised by length over the whole text; besides, the
strongest runs of words are taken by the ratio of the backed-off models, which copies of one text can't raise. A logistic
gives the score. It is fitted on folds that the models have not seen, within the learning rows only.

Null and empty texts have ratio 0 and the score of a text without evidence; without labels of both classes scores are 0.
Every row is scored, repeated ones too. A doc_id labelled both ways counts in both classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import read, sliced

ROWS = 3000  # labelled documents a class, chosen by a hash of the doc_id: the bound of what is learnt from
WORDS = 1_500_000  # words of a class's sample, at most; further sampled documents are left out whole
SPANS = (1, 2, 4, 8)  # lengths of the strongest run; the folds choose one
FOLDS = 3
THRESHOLD = 0.7
SOME = 500  # texts scored side by side
_WORD = re.compile(r"[^\W\d_]+")
BEGIN = 0  # number of what stands before the first word


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0 (none), 1, 2, and 3 or more."""
    n1, n2, n3, n4 = np.bincount(np.minimum(counts, 5), minlength=6)[1:5] + 0.5
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *[min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]])


def pair_keys(doc: np.ndarray) -> np.ndarray:
    """Each word with the word before it (BEGIN before the first) in one long; a document is its words' numbers."""
    return np.concatenate([[BEGIN], doc[:-1]])[: len(doc)] << 32 | doc


class Ratios:
    """Log-likelihood ratios of both classes' models: of words, of contexts (for pairs that no class has) and of known pairs.

    Documents are arrays of word numbers below ``kinds``, toxic is 0 or 1 for each; ``kinds`` itself is any other word.
    """

    def __init__(self, docs: list[np.ndarray], toxic: np.ndarray, kinds: int):
        found = []
        for y in (0, 1):
            mine = [np.unique(pair_keys(d)) for d, t in zip(docs, toxic) if t == y]
            found.append(np.unique(np.concatenate([np.zeros(0, np.int64), *mine]), return_counts=True))
        self.pairs = np.union1d(found[0][0], found[1][0])
        a, c = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        shared = np.bincount(c, minlength=kinds + 1)
        low = (shared + 1) / (shared.sum() + np.count_nonzero(shared) + 1)
        word, left, pair = [], [], []
        for keys, n in found:
            words = np.bincount(keys & 0xFFFFFFFF, minlength=kinds + 1)
            d = discounts(words[words > 0])[np.minimum(words, 3)]
            # A class without words falls back to the shared counts.
            word.append((np.maximum(words - d, 0) + d.sum() * low) / words.sum() if len(keys) else low)
            d = discounts(n)[np.minimum(n, 3)]
            after, gamma = (np.bincount(keys >> 32, weights=w, minlength=kinds + 1) for w in (n, d))
            left.append(np.divide(gamma, after, out=np.ones(kinds + 1), where=after > 0))
            kept = np.zeros(len(self.pairs))
            kept[np.searchsorted(self.pairs, keys)] = np.maximum(n - d, 0)
            pair.append(kept / np.maximum(after[a], 1) + left[-1][a] * word[-1][c])
        self.word, self.context, self.of = (np.log(x[1] / x[0]) for x in (word, left, pair))

    def __call__(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """[2, word] for each document: ratios of words after the word before, and by themselves."""
        size = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate([np.zeros(0, np.int64), *map(pair_keys, docs)])
        word = self.word[key & 0xFFFFFFFF]
        pair = self.context[key >> 32] + word
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == key
        pair[hit] = self.of[at[hit]]
        return np.split(np.stack([pair, word]), np.cumsum(size)[:-1], axis=1)


def numbered(words: list[str], ids: dict[str, int]) -> np.ndarray:
    """The numbers of words; those that were not learnt have the next number after the last."""
    none = len(ids)
    return np.fromiter((ids.get(w, none) for w in words), np.int64, len(words))


def features(r: np.ndarray, span: int) -> tuple[float, float]:
    """Mean ratio of the whole text and of its strongest run of ``span`` words (of a shorter text: over ``span``)."""
    if not r.shape[1]:
        return 0.0, 0.0
    s = np.concatenate([[0.0], np.cumsum(r[1])])
    k = min(span, len(s) - 1)
    return float(r[0].mean()), float((s[k:] - s[:-k]).max()) / span


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d, w = _design(x), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = _odds(d @ w)
        w = w + np.linalg.solve((d.T * (p * (1 - p))) @ d + 0.05 * np.eye(len(w)), d.T @ (y - p) - 0.05 * w)
    return w


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[list[str], int]]:
    """(words, toxic) of at most ROWS labelled documents a class; the ids are picked first, so texts are read once."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    order = F.xxhash64("doc_id")
    ids = rows.where("y = 1").orderBy(order, "doc_id").limit(ROWS).unionByName(rows.where("y = 0").orderBy(order, "doc_id").limit(ROWS))
    # 2 * ROWS ids at most, so the broadcast is bounded.
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").distinct()
    out, used, one = [], [0, 0], {}  # one: equal words are one object
    for r in sorted(picked.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, r["doc_id"], r["text"])):
        ws = tokens(r["text"])
        if used[r["y"]] + len(ws) <= WORDS:
            used[r["y"]] += len(ws)
            out.append(([one.setdefault(w, w) for w in ws], r["y"]))
    return out


def fit(rows: list[tuple[list[str], int]]) -> dict | None:
    """Learn from (words, toxic) rows; None without both classes."""
    if {y for _, y in rows} != {0, 1}:
        return None
    ids = {"": BEGIN}
    for ws, _ in rows:
        for w in ws:
            ids.setdefault(w, len(ids))
    docs, toxic, nth = [numbered(ws, ids) for ws, _ in rows], np.array([y for _, y in rows]), np.arange(len(rows)) % FOLDS
    learn = lambda at: Ratios([docs[i] for i in at], toxic[at], len(ids))
    folds: list[tuple[np.ndarray, int]] = []
    for f in range(FOLDS):
        seen, rest = np.flatnonzero(nth != f), np.flatnonzero(nth == f)
        if len(set(toxic[seen])) == 2 and len(rest):
            folds += zip(learn(seen)([docs[i] for i in rest]), toxic[rest].tolist())
    whole = learn(np.arange(len(rows)))
    if len({y for _, y in folds}) < 2:  # too few rows for folds
        folds = [*zip(whole(docs), toxic.tolist())]
    ys = np.array([y for _, y in folds], float)
    best = None
    for span in SPANS:
        x = np.array([features(r, span) for r, _ in folds])
        w = _logistic(x, ys)
        p = np.clip(_odds(_design(x) @ w), 1e-6, 1 - 1e-6)
        loss = -float(np.log(np.where(ys == 1, p, 1 - p)).sum())
        if best is None or loss < best[0]:
            best = (loss, span, w)
    return {"ids": ids, "ratios": whole, "span": best[1], "w": best[2]}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            out = np.zeros(len(b))
            for i in range(0, len(b) if m else 0, SOME):
                x = np.array([features(r, m["span"]) for r in m["ratios"]([numbered(tokens(t), m["ids"]) for t in b["text"].slice(i, SOME).to_pylist()])])
                out[i:i + SOME] = _odds(_design(x) @ m["w"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    return score(docs, fit(sample(docs, labels))).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
