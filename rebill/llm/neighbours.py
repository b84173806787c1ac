"""Approximate nearest neighbours: a robust-pruned directed graph a shard, searched by beams.

Nearness is the largest inner product; vectors get one more coordinate that makes it a least distance. Equal vectors
are one node and expand to their smallest ids. Vectors that are null, zero, or that hold null or non-finite
components take no part. Vectors of another length have no inner product, so each length has an index of its own and a
query finds those of its length. Of rows that repeat a vec_id the least vector counts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.llm.common import read, stored

SHARD, BLOCK = 4096, 4096  # vectors a shard, queries a block
DEGREE, BUILD, BEAM, ALPHA = 32, 64, 96, 1.2
TOP = 20


def beam(graph: np.ndarray, x: np.ndarray, q: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest found (ids, squared distances) of each query, nearest first; missing ones are -1, inf."""
    n, m = len(x), len(q)
    rows = np.arange(m)
    norm = (x * x).sum(1)
    ids = np.full((m, width), -1)
    dist = np.full((m, width), np.inf)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, norm[start] - 2 * (q @ x[start]), False
    seen[:, start] = True
    seen[:, n] = True
    while True:
        open_ = np.where(done, np.inf, dist)
        at = open_.argmin(1)
        live = np.flatnonzero(np.isfinite(open_[rows, at]))
        if not len(live):
            return ids, dist
        done[live, at[live]] = True
        nb = graph[ids[live, at[live]]]
        nb = np.where(nb < 0, n, nb)
        fresh = ~seen[live[:, None], nb]
        seen[live[:, None], nb] = True
        nb = np.where(fresh, nb, 0)
        d = norm[nb] - 2 * np.einsum("mrd,md->mr", x[nb], q[live])
        d = np.where(fresh, d, np.inf)
        all_i = np.concatenate([ids[live], np.where(fresh, nb, -1)], 1)
        all_d = np.concatenate([dist[live], d], 1)
        all_o = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_i, all_d, all_o))


def prune(points: np.ndarray, cand: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: keep the nearest candidate, drop those that it is much nearer to, and go on. -1 fills."""
    cand = np.where(cand == points[:, None], -1, cand)
    cx = x[np.maximum(cand, 0)]
    dp = ((cx - x[points][:, None]) ** 2).sum(2)
    dp = np.where(cand < 0, np.inf, dp)
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for r in range(degree):
        at = dp.argmin(1)
        ok = np.isfinite(dp[rows, at])
        if not ok.any():
            break
        out[ok, r] = cand[rows[ok], at[ok]]
        near = ((cx - cx[rows, at][:, None]) ** 2).sum(2)
        dp = np.where(ok[:, None] & (alpha * near <= dp), np.inf, dp)
        dp[rows, at] = np.inf
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Graph [n, DEGREE] of neighbour positions (-1 fills) and its start, the node nearest to the mean."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = rng.integers(0, n, (n, DEGREE)) if n > 1 else np.full((n, DEGREE), -1)
    graph[graph == np.arange(n)[:, None]] = -1
    for block in np.array_split(rng.permutation(n), max(1, -(-n // 256))):
        found, _ = beam(graph, x, x[block], BUILD, start)
        graph[block] = prune(block, np.concatenate([found, graph[block]], 1), x)
        back: dict[int, list[int]] = {}
        for p, row in zip(block.tolist(), graph[block].tolist()):
            for t in row:
                if t >= 0:
                    back.setdefault(t, []).append(p)
        nodes = np.array(sorted(back), np.int64)
        most = max(map(len, back.values()), default=0)
        more = np.full((len(nodes), most), -1)
        for i, t in enumerate(nodes.tolist()):
            more[i, : len(back[t])] = back[t]
        for s in range(0, len(nodes), 512):
            part = nodes[s:s + 512]
            graph[part] = prune(part, np.concatenate([graph[part], more[s:s + 512]], 1), x)
    return graph, start


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id, embedding) the nearest of ``vectors`` but itself."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda e: e != 0)
    one = F.min("embedding").alias("embedding")
    v = v.where(sound).groupBy("vec_id").agg(one)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = v.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top + 1)
    few = stored(few.withColumn("rep", F.min("vec_id").over(Window.partitionBy("embedding"))))
    nodes = few.where("nth = 1").select("vec_id", "embedding", F.size("embedding").alias("dim"))
    shards = stored(nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")))  # a row a length
    nodes = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")

    def index(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id").reset_index(drop=True)
        x = np.stack(g["embedding"].to_numpy()).astype(np.float64)
        sq = (x * x).sum(1)
        graph, start = build(np.column_stack([x, np.sqrt(np.maximum(sq.max() - sq, 0))]))
        return g.assign(pos=np.arange(len(g)), start=start, links=list(graph.astype(np.int32)))

    built = stored(nodes.groupBy("dim", "shard").applyInPandas(index, "vec_id long, embedding array<double>, dim int, shard int, pos int, start int, links array<int>"))
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = stored(q.where(sound).groupBy("vec_id").agg(one).withColumn("dim", F.size("embedding")))
    blocks = stored(q.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    below = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    block = F.expr("cast(pmod(xxhash64(vec_id), blocks) as int) as block")
    q = q.join(blocks, "dim").join(shards, "dim").select("vec_id", "embedding", "dim", block, below("shards").alias("shard"))
    served = built.join(blocks, "dim").select("vec_id", "embedding", "dim", "shard", "pos", "start", "links", below("blocks").alias("block"))

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "rep": [], "score": []})
        a = a.sort_values("pos")
        x, graph = np.stack(a["embedding"].to_numpy()), np.stack(a["links"].to_numpy()).astype(np.int64)
        sq = (x * x).sum(1)
        big = np.column_stack([x, np.sqrt(np.maximum(sq.max() - sq, 0))])
        ids, out = a["vec_id"].to_numpy(), []
        qs, qi = np.stack(b["embedding"].to_numpy()), b["vec_id"].to_numpy()
        for s in range(0, len(qs), 256):
            one = np.column_stack([qs[s:s + 256], np.zeros(len(qs[s:s + 256]))])
            found, _ = beam(graph, big, one, BEAM, int(a["start"].iloc[0]))
            i, j = np.nonzero(found[:, : top + 1] >= 0)
            p = found[i, j]
            out.append(pd.DataFrame({"query_id": qi[s + i], "rep": ids[p], "score": (qs[s + i] * x[p]).sum(1)}))
        return pd.concat(out)

    hits = q.groupBy("dim", "shard", "block").cogroup(served.groupBy("dim", "shard", "block")).applyInPandas(lambda b, a: find(a, b), "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).drop("r")
    members = few.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # top + 1 at most
    out = hits.join(members, "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(v, v.where("vec_id % 20 = 0"))
