"""Interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped by workers.

Words are those of ``common.word_table``; each text ends with one end token. Null texts count as empty (the end token
only); every row is scored, repeated ones too. With no training text every token gets 1/(V+1).

An n-gram is a 64-bit key. Those of a trigram (a, b, c) start with 40 bits of a hash of (a, b) and end with 24 bits of c, so
the trigrams of a context lie side by side in the sorted array and its totals are read off their counts. Bigrams are
keyed alike, by 33 bits of b and 31 of c, and hold continuation counts. A context shares its 40 bits with one of n others
with a chance of n / 10^12, a word its 31 with one of n others with n / 2 * 10^9. Tables are sorted by key ranges in Spark and
written as plain arrays to the shared folder; each range is one task's rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import mix, read, shared_dir, sliced, stored, word_table

END, BEGIN = np.uint64(0x1357), np.uint64(0x2468)
CHUNK = 4_000_000  # tokens whose counts are added up in a task before the shuffle
RANGE = 4_000_000  # n-grams of a file, about, while there are up to FILES files
FILES = 32  # beyond them, files grow as well as their number: each look-up of many tokens meets each file
LOOKUP = 2_500_000  # tokens that are looked up at once
TURN_BITS = 1  # bigrams and trigrams are counted in two ranges of keys, one after the other, so that shuffles stay small
TRI, BI = 24, 31  # bits of a key that the last word of a trigram, a bigram takes
BUFFER = 1 << 20  # rows that a task of a table merges at once, or as many as wait
PIECE = 512  # sorted rows that are shuffled as one row
PIECES = "k long, ks binary, xs binary"
AFTER = 31  # bits of a hash of the word before a bigram
WIDE = 16  # contexts of as many words or more keep their totals


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and ends of all texts, tokens of each text)."""
    w = word_table(texts)
    size = np.diff(w.first)
    out = np.full(len(w.hash) + len(size), END, np.uint64)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(len(size)), size)] = w.hash
    return out, size + 1


def contexts(t: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word two before, word before) of each token; BEGIN before a text."""
    b = np.concatenate([[BEGIN], t[:-1]]) if len(t) else t
    first = np.cumsum(size) - size
    b[first] = BEGIN
    a = np.concatenate([[BEGIN], b[:-1]]) if len(t) else t
    a[first] = BEGIN
    return a, b


def keyed(context: np.ndarray, c: np.ndarray, tail: int) -> np.ndarray:
    """Key of a word after a context: the last ``tail`` bits are of the word, those before of the context."""
    low = np.uint64((1 << tail) - 1)
    return (context & ~low) | (mix(c) & low)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def _signed(k: np.ndarray) -> np.ndarray:
    """As longs in the same order."""
    return (k ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(k: np.ndarray) -> np.ndarray:
    return k.view(np.uint64) ^ np.uint64(1 << 63)


def _packed(k: np.ndarray, x: np.ndarray, parts_bits: int) -> pa.RecordBatch:
    """Sorted k with its x as pieces of up to PIECE rows, none across two ranges: a row a piece, with its first key."""
    part = k >> (64 - parts_bits)
    cuts = np.unique(np.concatenate([np.arange(0, len(k), PIECE), np.flatnonzero(part[1:] != part[:-1]) + 1, [len(k)]]))
    x = x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.int64)
    whole = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * c.itemsize), pa.py_buffer(c)]) for c in (np.ascontiguousarray(k), x)]
    return pa.RecordBatch.from_arrays([pa.array(k[cuts[:-1]]), *(c.cast(pa.binary()) for c in whole)], names=["k", "ks", "xs"])


def _rows(pieces: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """k and x of pieces, one piece after another."""
    def whole(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
        return np.frombuffer(c.buffers()[2], np.uint8)[at[0]:at[-1]], np.diff(at)

    (ks, k_size), (xs, x_size) = whole(pieces["ks"]), whole(pieces["xs"])
    if (x_size * 2 == k_size).all():
        x = xs.view(np.uint32).astype(np.int64)
    else:
        cuts = np.concatenate([[0], np.cumsum(x_size)])
        x = np.concatenate([xs[i:j].view(np.uint32 if 2 * (j - i) == n else np.int64) for i, j, n in zip(cuts[:-1], cuts[1:], k_size)])
    return ks.view(np.int64), x


def _merged(batches: Iterator[pa.RecordBatch], distinct: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each key once, in order, with its sum of x or number of different x, from pieces sorted by their first keys.

    No later piece holds a key below the last first key, so what lies below is whole; the rest waits.
    """
    k, x = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        k_all, x_all = (np.concatenate(c) for c in zip((k, x), *held))
        order = np.argsort(k_all)
        k_all, x_all = k_all[order], x_all[order]
        if distinct:
            return _once(k_all, x_all)
        at = np.flatnonzero(_new(k_all))
        return k_all[at], np.add.reduceat(x_all, at)

    def final(k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not distinct:
            return k, x
        at = np.flatnonzero(_new(k))
        return k[at], np.diff(np.append(at, len(k)))

    for batch in batches:
        for i in range(0, len(batch), BUFFER // PIECE):
            pieces = batch.slice(i, BUFFER // PIECE)
            held.append(_rows(pieces))
            many += len(held[-1][0])
            if many >= max(BUFFER, len(k)):
                k, x = added()
                held, many = [], 0
                whole = int(np.searchsorted(k, pieces["k"][-1].as_py()))
                if whole:
                    yield final(k[:whole], x[:whole])
                    k, x = k[whole:].copy(), x[whole:].copy()
    if held:
        k, x = added()
    if len(k):
        yield final(k, x)


def _new(k: np.ndarray) -> np.ndarray:
    """Whether each of sorted keys differs from the one before."""
    return np.concatenate([[True], k[1:] != k[:-1]])[:len(k)]


def _once(k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of sorted k and x (of AFTER bits) once, sorted."""
    new = _new(k)
    both = np.sort((np.cumsum(new) - 1 << AFTER) | x)
    both = both[_new(both)]
    return k[new][both >> AFTER], both & ((1 << AFTER) - 1)


def counted(docs: DataFrame, order: int, turn: int = 0, parts_bits: int = 4) -> DataFrame:
    """Keys k and x of the n-grams of all texts whose key falls into a turn's range, added up in each task, in sorted pieces.

    Of order 1 and 3, x is a count; of order 2, k is a bigram (b, c) and x a hash of a word before it, each pair once. A
    piece is a row: its first key, its keys and its x; it has keys that agree on their first ``parts_bits``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def flush():
            rows = np.concatenate(held, axis=1)
            held.clear()
            k = _signed(rows[0])
            if order == 2:
                at = np.argsort(k)
                return _packed(*_once(k[at], rows[1, at].astype(np.int64)), parts_bits)
            return _packed(*np.unique(k, return_counts=True), parts_bits)

        for batch in sliced(batches):
            t, size = tokens(batch["text"])
            rows = t[None]
            if order > 1:
                a, b = contexts(t, size)
                rows = keyed(pair(a, b), t, TRI)[None] if order == 3 else np.stack([keyed(mix(b), t, BI), mix(a) >> np.uint64(64 - AFTER)])
                rows = rows[:, rows[0] >> np.uint64(64 - TURN_BITS) == np.uint64(turn)]
            held.append(rows)
            many += rows.shape[1]
            if many >= CHUNK:
                yield flush()
                held, many = [], 0
        if many:
            yield flush()

    return docs.select("text").mapInArrow(run, PIECES)


def _pieces(df: DataFrame, parts_bits: int) -> DataFrame:
    """Rows k, x in sorted pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x = b["k"].to_numpy(), b["x"].to_numpy()
            at = np.argsort(k)
            yield _packed(k[at], x[at], parts_bits)

    return df.mapInArrow(run, PIECES)


def _write(df: DataFrame, folder: str, parts_bits: int, tail: int, distinct: bool = False) -> DataFrame:
    """Merge pieces of (k, x) in the order of their keys and write each range of keys as arrays; rows of what was written.

    A range has the keys that agree on their first bits, so a context lies in one file. Of a file: keys, counts (a byte,
    larger ones apart) and the totals of contexts of WIDE words or more. ``distinct``: a count is that of different x.
    """
    k, sign = F.col("k"), F.lit(1 << (parts_bits - 1))
    part = (F.shiftright(k, 64 - parts_bits) + sign).cast("int")
    ordered = df.repartitionById(1 << parts_bits, part).sortWithinPartitions("k")
    shift, low = np.uint64(tail), np.uint64((1 << tail) - 1)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first = f"{folder}/{uuid.uuid4().hex}", None
        files, path = _fs(name)
        files.create_dir(os.path.dirname(path), recursive=True)
        sums = np.zeros(7, np.int64)  # n-grams, their sum, how many of 1, 2, 3, 4, and 3 or more
        wide: list[np.ndarray] = []
        over: list[np.ndarray] = []
        carry = None  # the context that the rows so far end with: key, words, total, ones, twos, more

        def put(k: np.ndarray, n: np.ndarray) -> None:
            nonlocal carry, sums
            keys.write(k.tobytes())
            counts.write(np.minimum(n, 255).astype(np.uint8).tobytes())
            big = n >= 255
            over.append(np.stack([k[big], n[big].astype(np.uint64)]))
            flags = [(n == 1), (n == 2), (n >= 3)]
            sums += [len(n), n.sum(), flags[0].sum(), flags[1].sum(), (n == 3).sum(), (n == 4).sum(), flags[2].sum()]
            c = k >> shift
            at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            rows = np.stack([c[at], np.diff(np.append(at, len(c))).astype(np.uint64), *[np.add.reduceat(x.astype(np.int64), at).astype(np.uint64) for x in (n, *flags)]])
            if carry is not None:
                if carry[0] == rows[0, 0]:
                    rows[1:, 0] += carry[1:]
                elif carry[1] >= WIDE:
                    wide.append(carry[:, None])
            carry = rows[:, -1].copy()
            rows = rows[:, :-1]
            wide.append(rows[:, rows[1] >= WIDE])

        words, many = [], 0  # last words of distinct bigrams
        with files.open_output_stream(path + ".k") as keys, files.open_output_stream(path + ".n") as counts:
            for k, n in _merged(batches, distinct):
                first = k[0] if first is None else first
                k = _unsigned(k)
                put(k, n)
                if distinct:
                    words.append((k & low).astype(np.int32))
                    many += len(k)
                    if many >= CHUNK:
                        yield listed(words)
                        words, many = [], 0
            if words:
                yield listed(words)
        if first is None:
            files.delete_file(path + ".k"), files.delete_file(path + ".n")
            return
        if carry is not None and carry[1] >= WIDE:
            wide.append(carry[:, None])
        for kind, x in ((".w", np.concatenate(wide, axis=1)), (".o", np.concatenate(over, axis=1))):
            with files.open_output_stream(path + kind) as out:
                out.write(np.ascontiguousarray(x).tobytes())
        none = pa.nulls(1, pa.int32())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([int(first)]), pa.array([name]), pa.array([sums.tolist()])], names=["word", "n", "k", "path", "sums"])

    def listed(words: list[np.ndarray]) -> pa.RecordBatch:
        """The last words of distinct bigrams, counted."""
        c, n = np.unique(np.concatenate(words), return_counts=True)
        none = pa.nulls(len(c))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n.astype(np.int32)), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.list_(pa.int64()))], names=["word", "n", "k", "path", "sums"])

    # A task that is run again writes files of other names; only those of the task that counts are listed.
    return stored(ordered.mapInArrow(save, "word int, n int, k long, path string, sums array<long>"))


def _fs(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


def _file(uri: str, kind: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the shared folder is mounted, else read (the caller holds one at a time)."""
    files, path = _fs(uri + kind)
    if os.path.exists(path):
        return np.memmap(path, dtype, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, dtype)
    return np.frombuffer(files.open_input_file(path).read(), dtype)


class Table:
    """Sorted keys and counts in files by key range; a key's context is what is left of its last ``tail`` bits."""

    def __init__(self, written: DataFrame, tail: int):
        rows = written.where("path is not null").select("k", "path", "sums").collect()  # a row a file
        rows = sorted((int(r["k"]) + (1 << 63), r["path"], r["sums"]) for r in rows)
        self.starts, self.paths, self.tail = np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], tail
        self.sums = np.array([r[2] for r in rows], np.int64).reshape(-1, 7).sum(0)

    def discounts(self) -> list[float]:
        """Modified Kneser-Ney discounts from the counts of counts."""
        n1, n2, n3, n4 = (x + 0.5 for x in self.sums[2:6])
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]

    def _by_file(self, of: np.ndarray) -> Iterator[tuple]:
        """The numbers of the keys of each file (of: a key's file), and the file's keys, counts and name."""
        ends = np.flatnonzero(np.diff(of, append=len(self.paths)))  # keys are sorted, and so are files
        for i, j in zip(np.concatenate([[0], ends[:-1] + 1]), ends + 1):
            if of[i] >= 0:
                path = self.paths[of[i]]
                yield slice(i, j), _file(path, ".k", np.uint64), _file(path, ".n", np.uint8), path

    def counts(self, uniq: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, 0 where there is none."""
        out = np.zeros(len(uniq), np.int64)
        for sel, k, n, path in self._by_file(np.searchsorted(self.starts, uniq, "right") - 1):
            i = np.minimum(np.searchsorted(k, uniq[sel]), len(k) - 1)
            out[sel] = np.where(k[i] == uniq[sel], _counts(i, k, n, path), 0)
        return out

    def level(self, keys: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
        """Probabilities of keys in their contexts with discounts ``d``, backed off to ``lower``."""
        uniq, back = _inverse(keys)
        own, rest_mass = np.zeros(len(uniq)), np.ones(len(uniq))
        off, shift = np.array([0.0, *d]), np.uint64(self.tail)
        # A context lies in one file: keys before a file's first one may still share the context of it.
        for sel, k, n, path in self._by_file(np.searchsorted(self.starts >> shift, uniq >> shift, "right") - 1):
            u, wide = uniq[sel], _file(path, ".w", np.uint64).reshape(6, -1)
            c = u >> shift
            new = np.concatenate([[True], c[1:] != c[:-1]])
            cu, cb = c[new], np.cumsum(new) - 1
            total, mass, first, size = np.zeros(len(cu)), np.zeros(len(cu)), np.zeros(len(cu), np.int64), np.zeros(len(cu), np.int64)
            at = np.minimum(np.searchsorted(wide[0], cu), max(wide.shape[1] - 1, 0))
            found = wide[0][at] == cu if wide.shape[1] else np.zeros(len(cu), bool)
            total[found] = wide[2, at[found]]
            mass[found] = off[1:] @ wide[3:, at[found]]
            # Other contexts have fewer than WIDE words, side by side: where they begin is searched, the rest are steps.
            live = np.flatnonzero(~found)
            first[live] = np.searchsorted(k, cu[live] << shift)
            while len(live):
                i = first[live] + size[live]
                live = live[(i < len(k)) & (k[np.minimum(i, len(k) - 1)] >> shift == cu[live])]
                size[live] += 1
            some = np.flatnonzero(size)
            begin = np.cumsum(size[some]) - size[some]
            place = np.arange(int(size.sum())) + np.repeat(first[some] - begin, size[some])
            if len(some):
                x = _counts(place, k, n, path)
                total[some] = np.add.reduceat(x, begin)
                mass[some] = np.add.reduceat(off[np.minimum(x, 3)], begin)
            at, hit = first[cb], found[cb]
            at[hit] = np.minimum(np.searchsorted(k, u[hit]), len(k) - 1)
            live = np.flatnonzero(size[cb] > 1)
            end = first[cb] + size[cb] - 1
            while len(live):
                live = live[(k[at[live]] < u[live]) & (at[live] < end[live])]
                at[live] += 1
            hit |= size[cb] > 0
            x = np.zeros(len(u), np.int64)
            hit = np.flatnonzero(hit)
            hit = hit[k[at[hit]] == u[hit]]
            x[hit] = _counts(at[hit], k, n, path)
            safe, known = np.maximum(total, 1)[cb], (total > 0)[cb]
            own[sel] = (x - off[np.minimum(x, 3)]) / safe
            rest_mass[sel] = np.where(known, mass[cb] / safe, 1.0)
        return own[back] + rest_mass[back] * lower


def _counts(at: np.ndarray, k: np.ndarray, n: np.ndarray, path: str) -> np.ndarray:
    """Counts at places of a file; larger ones are looked up by key."""
    c = n[at].astype(np.int64)
    large = np.flatnonzero(c == 255)
    if len(large):
        big = _file(path, ".o", np.uint64).reshape(2, -1)
        c[large] = big[1][np.searchsorted(big[0], k[at[large]])].astype(np.int64)
    return c


def _inverse(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and where each key is among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def _bits(rows: float) -> int:
    """Bits of the number of files: it grows with the rows up to FILES, with their square root from there on."""
    files = max(rows / RANGE, 1)
    return int(np.clip(np.ceil(np.log2(min(files, (files * FILES) ** 0.5))), 1, 20))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, tokens and their number a text, of batches together until they have LOOKUP tokens."""
    held, many = [], 0
    for b in sliced(batches):
        held.append((b["doc_id"], *tokens(b["text"])))
        many += len(held[-1][1])
        if many >= LOOKUP:
            yield _joined(held)
            held, many = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, t, size = zip(*held)
    return pa.concat_arrays(ids), np.concatenate(t), np.concatenate(size)


def train(docs: DataFrame) -> dict:
    """Count the model over all of ``docs`` (text) and write its tables; what is returned is small."""
    folder = shared_dir(docs.sparkSession)
    # Words are known by 31 bits in bigrams and as their last words, by 64 bits where they are counted.
    turns = range(1 << TURN_BITS)
    raw = _write(counted(docs, 1, parts_bits=4), f"{folder}/raw", 4, 0)
    raw_table = Table(raw, 0)
    big_n = int(raw_table.sums[1])
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    bits = max(TURN_BITS + 1, _bits(big_n))
    bi = union([_write(counted(docs, 2, i, bits), f"{folder}/bi", bits, BI, True) for i in turns])
    tri = union([_write(counted(docs, 3, i, bits), f"{folder}/tri", bits, TRI) for i in turns])
    last = bi.where("word is not null").groupBy(F.col("word").cast("long").alias("k")).agg(F.sum("n").alias("x"))
    # Last words are placed at the top of the key, so that they spread over the files.
    last = last.select((F.shiftleft("k", 64 - BI)).bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("k"), "x")
    uni = _write(_pieces(last, 4), f"{folder}/uni", 4, 0)
    return {"raw": raw_table, "uni": Table(uni, 0), "bi": Table(bi, BI), "tri": Table(tri, TRI)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text."""
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    raw, uni, bi, tri = (model[x] for x in ("raw", "uni", "bi", "tri"))
    big_n, v = int(raw.sums[1]), int(raw.sums[0])
    d1, d2, d3 = uni.discounts(), bi.discounts(), tri.discounts()

    def last_words(words: np.ndarray) -> np.ndarray:
        """Probabilities of distinct words by the bigrams that they end."""
        uniq, back = _inverse(keyed(np.zeros(1, np.uint64), words, BI) << np.uint64(64 - BI))
        n, off, total = uni.counts(uniq), np.array([0.0, *d1]), max(int(uni.sums[1]), 1)
        rest = off[1:] @ uni.sums[[2, 3, 6]] / total if uni.sums[1] else 1.0
        return ((n - off[np.minimum(n, 3)]) / total + rest / (v + 1))[back]

    def logs(t: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base, logs) of tokens."""
        a, b = contexts(t, size)
        words, at = _inverse(t)
        count = raw.counts(words)
        base = np.log10((count + 1) / (big_n + v + 1))[at]
        p = last_words(words)[at]
        p = bi.level(keyed(mix(b), t, BI), d2, p)
        p = tri.level(keyed(pair(a, b), t, TRI), d3, p)
        return (count > 0)[at], base, np.log10(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t, size in _gathered(batches):
            at = np.cumsum(size) - size
            known, base, log = (np.add.reduceat(x.astype(float), at) for x in logs(t, size))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = train(docs.where(~held))
    n = F.lit(int(model["raw"].sums[1])).cast("long").alias("train_tokens")
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", n, "base_score", "score")
