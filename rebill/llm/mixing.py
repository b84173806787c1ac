"""Mixing sources to target weights by cube-method balanced sampling.

A document is taken floor(target / source size) times, and once more with the fractional rest as inclusion
probability. Flights move these through the null space of (document count, word count) in blocks of a source;
what a block leaves open (two documents at most) flies on in the next round, until one small landing a source.
Single draws are turned over where that brings a source nearer its target, whatever its size.
Null texts have no words; a source without words has target 0. Repeated rows are drawn apart from each other. A row
is known by its id and a hash of all its columns, so rows with a null id or another row's id are mixed by themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.llm.common import read, stored

BLOCK = 2000  # documents of a flight, about
CAP = 3
WEIGHTS = (5, 2, 1)


def targets(sizes: list[tuple[str | None, int]], cap: int = CAP) -> dict:
    """Source: target words. Sources by code point, null last, weigh 5, 2, 1, repeating; caps are reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total, out, free = float(sum(size.values())), {}, [s for s, _ in order]
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * size[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: float(cap * size[s]) for s in over}
        free = [s for s in free if s not in over]
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p along null vectors of x (rows: units) until at most x.shape[1] units are open."""
    p = p.copy()
    k = x.shape[1]
    open_ = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    while len(open_) > k:
        at = open_[: k + 1]
        u = np.linalg.svd(x[at].T)[2][-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - p[at]) / u, np.where(u < -1e-12, -p[at] / u, np.inf)).min()
            down = np.where(u > 1e-12, p[at] / u, np.where(u < -1e-12, (p[at] - 1) / u, np.inf)).min()
        p[at] += u * up if rng.random() < down / (up + down) else -u * down
        p[np.abs(p) < 1e-9] = 0
        p[np.abs(p - 1) < 1e-9] = 1
        open_ = [i for i in at if 0 < p[i] < 1] + open_[k + 1:]
    return p


def turned(p: np.ndarray, size: np.ndarray, off: float) -> np.ndarray:
    """p with single draws turned over, each time the best one, while that brings ``off`` (words wanting) nearer 0.

    Where words are still wanting, the same is tried after turning over each of the largest documents for good.
    """
    best, start = (abs(off), p), [None, *np.argsort(-size, kind="stable")[:12]]
    for at in start:
        q, left = p.copy(), off
        if at is not None:
            left -= -size[at] if q[at] > 0.5 else size[at]
            q[at] = 1 - q[at]
        while len(q):
            change = np.where(q > 0.5, -size, size)
            if at is not None:
                change[np.abs(change) > abs(left)] = 0  # nothing overshoots
                change[at] = 0
            i = int(np.argmin(np.abs(left - change)))
            if abs(left - change[i]) >= abs(left):
                break
            left -= change[i]
            q[i] = 1 - q[i]
        if abs(left) < best[0]:
            best = (abs(left), q)
        if best[0] < 1:
            break
    return best[1]


def _fly(df: DataFrame) -> DataFrame:
    """One flight a block; sources of one block land."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
        p, size = g["p"].to_numpy(float).copy(), g["size"].to_numpy(float)
        x = np.column_stack([np.ones(len(p)), size / max(size.mean(), 1)])
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{g['source'][0]}|{g['block'][0]}|{len(g)}"))
        p = flight(p, x, rng)
        if g["blocks"][0] <= 1:
            # The few open units take the rounding nearest to their words.
            at = np.flatnonzero((p > 0) & (p < 1))
            aim = (p[at] * size[at]).sum()
            best = min(range(1 << len(at)), key=lambda b: abs(sum(size[i] for j, i in enumerate(at) if b >> j & 1) - aim))
            p[at] = [best >> j & 1 for j in range(len(at))]
        g["p"] = p
        return g

    cols = ["doc_id", "source", "size", "h", "block", "blocks", "p"]
    return df.select(*cols).groupBy("source", "block").applyInPandas(run, "doc_id long, source string, size long, h long, block long, blocks long, p double")


def _turn_over(live: DataFrame, drawn: DataFrame) -> DataFrame:
    """doc_id, h, p (1 or -1): draws to turn over, alike in every source, as a landing saw only open documents.

    The candidates are some drawn and undrawn documents of each size class of a source (sizes below 64, then 16 an
    octave), which bounds a source's group by its size classes.
    """
    want = live.groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("want"))
    have = drawn.groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("have"))
    same = want["source"].eqNullSafe(have["source"])
    off = want.join(have, same).select(want["source"].alias("s"), (F.col("want") - F.col("have")).alias("off"))  # a row a source
    group = F.when(F.col("size") < 64, F.col("size")).otherwise(64 + F.floor(F.log2("size") * 16))
    rows = drawn.where("size > 0").withColumn("class", group)
    nth = F.row_number().over(Window.partitionBy("source", "p", "class").orderBy("h", "doc_id"))
    rows = rows.withColumn("nth", nth).where("nth <= 8")
    rows = rows.join(F.broadcast(off), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "h", "p", "off")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
        p = g["p"].to_numpy(float)
        g["p"] = turned(p, g["size"].to_numpy(float), float(g["off"][0])) - p
        return g.loc[g["p"] != 0, ["doc_id", "h", "p"]]

    return rows.groupBy("source").applyInPandas(run, "doc_id long, h long, p double")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*docs.columns)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, h (hash of the row of ``docs``), times (copies of the row), taken."""
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size"), row_hash(docs).alias("h")))
    sums = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]  # a row a source
    aim = targets([(s, n) for s, n, _ in sums])
    table = rows.sparkSession.createDataFrame(
        [(s, n, aim[s], aim[s] / n if n else 0.0, max(1, -(-c // BLOCK))) for s, n, c in sums],
        "source string, source_size long, target double, ratio double, blocks long")
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    rows = rows.withColumn("k", key("source")).join(table.withColumn("k", key("source")).drop("source"), "k").drop("k")
    rows = rows.withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    rows = stored(rows.withColumn("block", F.pmod(F.col("h"), F.col("blocks"))))
    live = rows.where("p > 1e-9")
    many = max([c for *_, c in sums] or [0])
    done, blocks = [], -(-many // BLOCK)
    first = live = stored(live)
    while True:
        live = stored(_fly(live))
        done.append(live.where("p = 0 or p = 1"))
        if blocks <= 1:
            break
        up = [F.floor(F.col("block") / (BLOCK // 2)).alias("block"), F.ceil(F.col("blocks") / (BLOCK // 2)).alias("blocks")]
        live = live.where("p > 0 and p < 1").select("doc_id", "source", "size", "h", *up, "p")
        blocks = -(-blocks // (BLOCK // 2))
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    drawn = drawn.select("doc_id", "h", "source", "size", "p")
    drawn = drawn.select("doc_id", "h", "p").unionByName(_turn_over(first, drawn))
    # Twins (equal id, text and source) are told apart by nothing, so their draws are added up and shared out.
    drawn = drawn.groupBy("doc_id", "h").agg(F.sum("p").cast("long").alias("extra"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("size"))
    drawn = drawn.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "extra")
    out = rows.join(drawn, (F.col("h") == F.col("dh")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d", "dh").withColumn("nth", nth)
    times = F.col("whole") + F.when(F.col("nth") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "h", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
