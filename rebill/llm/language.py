"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built for each language; a text is parsed into longest matches against
each, and the language that needs the fewest phrases a symbol wins (ties: the first by name). Any symbol counts, with a
place of its own in a sparse table of transitions. Null texts and texts without a letter are ``und`` with score 0. With
nothing to learn from, every text is ``und``. Every row is labelled, repeated ones too.

What is learnt from is a bounded sample: of each language about ROWS different texts, chosen by a hash of the text, of
each text a piece of PART characters at a place chosen by its hash, and SYMBOLS in all (less where there are so many
languages that all of them together would pass TOTAL).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rebill.llm.common import read, sliced

ROWS, PART = 200, 2000
SYMBOLS, TOTAL = 40_000, 640_000
WIDE = 64  # symbols with a column of their own, a power of two
LONGEST = 4096  # symbols parsed in one go; what a longer text's next part begins with is put right afterwards
TOGETHER = 1000  # parts of about a length that are parsed side by side
_GAP = re.compile(r"[\W\d_]+")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # keys times this spread over the table


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions {symbol: state} of each state of the suffix automaton; no state leads back to the root, 0."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Transitions:
    """All automata in two tables; symbols are numbered from 1 by falling frequency, 0 is any that was not learnt.

    The WIDE most frequent symbols have a column each in a table of all states, which also says where a symbol that a
    state can't take in leads to: (next state) * WIDE, plus 1 where a phrase begins. Transitions by other symbols are
    in a sparse table: state and symbol are hashed to a slot, taken slots pass on to the next; a slot holds (state,
    symbol, next state) in one long.
    """

    def __init__(self, automata: list[list[dict[int, int]]]):
        codes = np.array([c for states in automata for row in states for c in row], np.int64)
        found, often = np.unique(codes, return_counts=True)
        found = found[np.argsort(-often, kind="stable")]
        self.symbols = np.zeros(0x110000, np.uint32)
        self.symbols[found] = np.arange(1, len(found) + 1)
        sizes = [len(states) for states in automata]
        self.roots = 1 + np.cumsum([0, *sizes])[:-1]
        states, width = (1 + sum(sizes)).bit_length(), len(found).bit_length()
        if 2 * states + width > 64 or states > 26:
            raise ValueError("too much to learn from for the tables")
        state = np.array([r + i for r, a in zip(self.roots, automata) for i, row in enumerate(a) for _ in row], np.int64)
        to = np.array([r + j for r, a in zip(self.roots, automata) for row in a for j in row.values()], np.int64)
        symbol = self.symbols[codes].astype(np.int64)
        self.first = np.repeat(self.roots[:, None], len(found) + 1, axis=1)  # from the roots, the roots where there is none
        lang = np.searchsorted(self.roots, state, "right") - 1
        at_root = state == self.roots[lang] if len(state) else np.zeros(0, bool)
        self.first[lang[at_root], symbol[at_root]] = to[at_root]
        self.wide = np.zeros((1 + sum(sizes), WIDE), np.uint32)
        for r, n, row in zip(self.roots, sizes, self.first):
            self.wide[r:r + n, : len(row)] = row[:WIDE] * WIDE + 1
            self.wide[r:r + n, len(row):] = r * WIDE + 1
        common = symbol < WIDE
        self.wide[state[common], symbol[common]] = to[common] * WIDE + at_root[common]
        self.wide = self.wide.ravel()
        self.width, self.states = np.uint64(width), np.uint64(states)
        state, symbol, to = (x[~common].astype(np.uint64) for x in (state, symbol, to))
        self.shift = np.uint64(64 - max(4, (2 * len(state)).bit_length()))
        key = state << self.width | symbol
        entry, slot = key << self.states | to, key * _SPREAD >> self.shift
        self.table = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        while len(entry):
            # Of the entries that want a free slot the first takes it; the others try the next one.
            _, take = np.unique(slot, return_index=True)
            take = take[self.table[slot[take]] == 0]
            self.table[slot[take]] = entry[take]
            rest = np.ones(len(entry), bool)
            rest[take] = False
            entry, slot = entry[rest], (slot[rest] + np.uint64(1)) & np.uint64(len(self.table) - 1)

    def rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states by symbols from WIDE on, 0 where there is none."""
        key = state.astype(np.uint64) << self.width | symbol.astype(np.uint64)
        slot = key * _SPREAD >> self.shift
        out = np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            entry = self.table[slot[open_]]
            hit = entry >> self.states == key[open_]
            out[open_[hit]] = (entry[hit] & np.uint64((1 << int(self.states)) - 1)).astype(np.int64)
            open_ = open_[~hit & (entry != 0)]
            slot[open_] = (slot[open_] + np.uint64(1)) & np.uint64(len(self.table) - 1)
        return out

    def start(self, n: int) -> np.ndarray:
        """Places [language, text] at the roots, as ``step`` takes them."""
        return np.repeat((self.roots * WIDE).astype(np.uint32)[:, None], n, axis=1)

    def step(self, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next places [language, text] after a symbol of each text, and 1 where a phrase begins.

        A phrase begins at a root, and with a symbol that the one before can't take in.
        """
        out = self.wide.take(place + (symbol & np.uint32(WIDE - 1)))
        if (at := np.flatnonzero(symbol >= WIDE)).size:
            s, c = place[:, at].astype(np.int64) // WIDE, symbol[at].astype(np.int64)
            to = self.rare(s.ravel(), np.tile(c, len(s))).reshape(s.shape)
            out[:, at] = np.where(to == 0, self.first[:, c], to) * WIDE + ((to == 0) | (s == self.roots[:, None]))
        begins = out & np.uint32(1)
        out -= begins
        return out, begins


def plain(text: str) -> str:
    return _GAP.sub(" ", text.lower())


def fit(rows: DataFrame) -> dict:
    """Learn from ``rows`` (text, lang) with non-null values; a bounded sample."""
    rows = rows.where("text is not null and lang is not null")
    h = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}  # a row a language
    texts: dict[str, list[str]] = {k: [] for k in counts}
    if counts:
        share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, ROWS / max(n, 1)))])[F.col("lang")]
        place = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - PART + 1, F.lit(1))).cast("int")
        picked = rows.where(F.pmod(h, F.lit(1 << 30)) < share * float(1 << 30)).select("lang", F.substring("text", place, F.lit(PART)).alias("text"), h.alias("h"))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        sample = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("nth", nth).where(F.col("nth") <= 2 * ROWS)
        for r in sample.orderBy("lang", "h").collect():
            texts[r["lang"]].append(plain(r["text"]))
    # Each text gives the same share, so that one long text does not fill the sample.
    most = min(SYMBOLS, TOTAL // max(1, len(texts)))
    joined = {k: " ".join(x[: max(200, most // max(1, len(v)))] for x in v)[:most] for k, v in texts.items()}
    names = sorted(k for k, v in joined.items() if v)
    return {"names": names, "table": Transitions([automaton([ord(c) for c in joined[k]]) for k in names])}


def phrases(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Phrases [text, language] and symbols [text] of whole texts, parsed side by side."""
    table = model["table"]
    parts, owner = [], []
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        x = np.frombuffer(plain(t).encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32)
        size[i] = len(x)
        for s in range(0, len(x), LONGEST):
            parts.append(x[s:s + LONGEST])
            owner.append(i)
    out = np.zeros((len(texts), len(table.roots)), np.int64)
    if not parts:
        return out, size
    length = np.array([len(x) for x in parts])
    order = np.argsort(-length, kind="stable")
    made = np.zeros((len(table.roots), len(parts)), np.int64)
    ends = table.start(len(parts))
    for g in range(0, len(parts), TOGETHER):
        group = order[g:g + TOGETHER]
        symbols = np.zeros((length[group[0]], len(group)), np.uint32)
        for i, j in enumerate(group):
            symbols[: length[j], i] = table.symbols[parts[j]]
        place, count = table.start(len(group)), np.zeros((len(table.roots), len(group)), np.uint32)
        live = len(group) - np.searchsorted(length[group][::-1], np.arange(len(symbols)), "right")
        now = place
        for row, n in zip(symbols, live):
            if n < now.shape[1]:
                place[:, : now.shape[1]] = now
                now = now[:, :n]
            now, begins = table.step(now, row[:n])
            count[:, :n] += begins
        place[:, : now.shape[1]] = now
        made[:, group], ends[:, group] = count, place
    made += _joined(table, parts, np.array(owner), length, ends)
    np.add.at(out, owner, made.T)
    return out, size


def _joined(table: Transitions, parts: list[np.ndarray], owner: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What to add to the phrases [language, part] of parts parsed from the roots, as they go on from the part before.

    Such parts are parsed again from where the one before ended, side by side, until both ways meet. A part in which
    they don't meet ends elsewhere, and so the next one is parsed again.
    """
    more, alone, ends = np.zeros(ends.shape, np.int64), ends, ends.copy()
    flat, start = table.symbols[np.concatenate(parts)], np.cumsum(length) - length
    todo = 1 + np.flatnonzero(owner[1:] == owner[:-1])
    while len(todo):
        more[:, todo] = 0
        after = alone[:, todo]
        now, was, i = ends[:, todo - 1], table.start(len(todo)), 0
        open_ = np.arange(len(todo))
        while len(open_):
            part = todo[open_]
            now, begins = table.step(now, flat[start[part] + i])
            was, began = table.step(was, flat[start[part] + i])
            more[:, part] += begins.astype(np.int64) - began
            i += 1
            apart, over = (now != was).any(axis=0), length[part] == i
            after[:, open_[apart & over]] = now[:, apart & over]
            go = apart & ~over
            open_, now, was = open_[go], now[:, go], was[:, go]
        other = todo[(after != ends[:, todo]).any(axis=0)] + 1
        ends[:, todo] = after
        other = other[other < len(parts)]
        todo = other[owner[other] == owner[other - 1]]
    return more


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred, score (0 to 1), rate (phrases a symbol) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = m["names"]
        for b in sliced(batches):
            texts = b["text"].to_pylist()
            lang, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if names and texts:
                got, size = phrases(texts, m)
                for i, t in enumerate(texts):
                    if t and any(map(str.isalpha, t)):
                        j = int(got[i].argmin())
                        z = np.exp(np.clip((got[i, j] - got[i]) * 0.5, -50, 0))
                        lang[i], score[i], rate[i] = names[j], 1 / z.sum(), got[i, j] / max(size[i], 1)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(lang), pa.array(score), pa.array(rate)], names=[*keep, "lang_pred", "score", "rate"])

    docs = docs.select("text", *[c for c in keep if c != "text"])
    schema = StructType([*[StructField(c, docs.schema[c].dataType) for c in keep], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rate", DoubleType())])
    return docs.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(docs, fit(docs.where(~held).select("text", "lang"))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
