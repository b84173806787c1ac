"""Prefix trie of conversations: ternary search trees a range shard, and one merge of the nodes that shards share.

A conversation is its turns by ``turn`` (null first; equal turns by role, then by digest). Null roles and texts count as
empty. Rows without conv_id take no part; rows of one conv_id are one conversation. An empty table has no node, not even
a root. Other columns are not looked at. A turn is a digest of role and text (128 bits of SHA-256) and the text's length,
so texts are read once and never shuffled; the digests of one conversation's turns (20 bytes a turn) are held together.

Equal conversations are one sequence with a number of members. Sequences are ranged by their bytes, so that a subtree is
a run of shards and only prefixes common to neighbouring shards exist in several. For those every sum is a plain sum
over shards, since each node is owned by the first shard that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import dropped, read, stored

TURN = 20  # bytes a turn: digest, code points of the text
CHUNK = 1 << 20  # bytes of ids hashed or passed on at once
SHARED = 100_000  # shared nodes up to which they are broadcast
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "node binary, parent binary, shared boolean")
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of one hex string a turn, in order) of every conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    turn = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))
    x = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn.alias("id")).alias("t"))
    return x.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _in_order), lambda t: t["id"]).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    """A comparison by turn with nulls first, role and id."""
    less = lambda p, q: F.when(p < q, -1).when(p > q, 1)
    null = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(null, less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["id"], b["id"]), F.lit(0))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 100, then c's own after its first h; h is crc32(c) % 6.

    The remainder of a negative c is negative, as in SQL.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    x = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    base = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("turns").alias("theirs"))
    theirs = F.coalesce(F.slice("theirs", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))
    return x.join(base, "base", "left").select("conv_id", F.concat(theirs, own).alias("turns"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of (seq, conv_id): pieces of each sequence's joined ids; those of sequences that can't go on elsewhere are hashed."""
    key, ids, size, part, out = None, [], 0, 0, []

    def piece(whole: bool) -> tuple:
        text = ",".join(map(str, ids))
        return (key, int(ids[0]), text.encode(), None) if not whole else (key, int(ids[0]), None, hashlib.sha256(text.encode()).hexdigest())

    first = True  # whether the current sequence is the first of the task, so that an earlier task may hold some of it
    for b in batches:
        for k, c in zip(b["seq"], b["conv_id"]):
            k = bytes(k)
            if k != key or size > CHUNK:
                if key is not None:
                    out.append(piece(k != key and not first and not part))
                    first = first and k == key
                part = part + 1 if k == key else 0
                key, ids, size = k, [], 0
            ids.append(c)
            size += 12
        if out:
            yield pd.DataFrame(out, columns=["seq", "at", "piece", "sha"])
            out = []
    if key is not None:
        yield pd.DataFrame([piece(False)], columns=["seq", "at", "piece", "sha"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each sequence, which come in order."""
    key, state = None, None
    for b in batches:
        out = []
        for k, piece in zip(b["seq"], b["piece"]):
            if bytes(k) != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = bytes(k), hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield pd.DataFrame(out, columns=["seq", "sha"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["seq", "sha"])


def ends(members: DataFrame) -> DataFrame:
    """seq, sha: SHA-256 of the ascending conv_ids, joined by commas, of each sequence of ``members`` (seq, conv_id).

    A sequence's members may lie in many tasks: these pass on joined pieces, which one task streams.
    """
    ranged = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = stored(ranged.mapInPandas(_hashed, "seq binary, at long, piece binary, sha string"))
    split = pieces.where("sha is null").select("seq", "at", "piece").repartition("seq").sortWithinPartitions("seq", "at")
    return pieces.where("sha is not null").select("seq", "sha").unionByName(split.mapInPandas(_joined, "seq binary, sha string"))


class Tree:
    """A ternary search tree of turn ids: lists by node, with the node of the trie's parent; node 0 is the root of the trie."""

    def __init__(self) -> None:
        self.id, self.low, self.high, self.below, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def insert(self, ids: list[int]) -> int:
        """The node in which the sequence ends."""
        at = 0
        for i in ids:
            side, turn = self.below, at  # list and index of the link to follow
            while nxt := side[turn]:
                turn = nxt
                if i == self.id[turn]:
                    break
                side = self.low if i < self.id[turn] else self.high
            else:
                side[turn] = len(self.id)
                self.id.append(i)
                for links in (self.low, self.high, self.below):
                    links.append(0)
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                turn = len(self.id) - 1
            at = turn
        return at

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def nodes_of(seqs: list[bytes], members: list[int], least: list[int], shas: list[str], before: int, after: int) -> dict[str, list]:
    """NODE columns of the trie of a shard's sequences (distinct, ascending).

    ``before`` and ``after`` are the turns that the first and last sequence share with the shards around; -1: there is none.
    """
    turns = [[s[i:i + TURN] for i in range(0, len(s), TURN)] for s in seqs]
    words = sorted({t for ts in turns for t in ts})
    code = {t: i for i, t in enumerate(words)}
    tree, end = Tree(), [0] * len(seqs)
    todo = [(0, len(seqs))]
    for lo, hi in todo:  # medians first, so that brothers are balanced
        if lo < hi:
            mid = (lo + hi) // 2
            end[mid] = tree.insert([code[t] for t in turns[mid]])
            todo += [(lo, mid), (mid + 1, hi)]
    n = len(tree.id)
    first, last = tree.path(end[0]), tree.path(end[-1])
    theirs, shared = set(first[:before + 1]), set(first[:before + 1]) | set(last[:after + 1])
    size = [0] + [int.from_bytes(words[i][16:], "big") for i in tree.id[1:]]
    count, small, children, leaves, sha = [0] * n, [None] * n, [0] * n, [0] * n, [NOTHING] * n
    for e, m, c, h in zip(end, members, least, shas):
        count[e], small[e], sha[e] = m, c, h
    saved = [0 if i in theirs else -size[i] for i in range(n)]
    for i in range(n - 1, -1, -1):  # children come after their parents
        saved[i] += count[i] * size[i]
        if not tree.below[i] and i not in theirs and not (i == last[-1] and i in shared and len(last) <= after + 1):
            leaves[i] = 1
        p = tree.parent[i]
        if p >= 0:
            count[p] += count[i]
            saved[p] += saved[i]
            leaves[p] += leaves[i]
            children[p] += i not in theirs
            small[p] = small[i] if small[p] is None else min(small[p], small[i])
    keys: dict[int, bytes] = {}
    for path, deep in ((first, before), (last, after)):
        h = hashlib.sha256()
        for d, i in enumerate(path[:deep + 1]):
            if d:
                h.update(words[tree.id[i]])
            keys[i] = d.to_bytes(8, "big") + h.digest()
    parents = [None if p < 0 else keys.get(p) for p in tree.parent]
    over = [None if p < 0 or p in keys else small[p] for p in tree.parent]
    return {
        "conv_id": small, "depth": tree.depth, "parent_conv_id": over, "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": sha, "node": [keys.get(i) for i in range(n)], "parent": parents, "shared": [i in shared for i in range(n)]}


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    n = min(len(a), len(b)) // TURN
    lo = 0
    while lo < n:  # the longest equal prefix by halving
        mid = (lo + n + 1) // 2
        lo, n = (mid, n) if a[:mid * TURN] == b[:mid * TURN] else (lo, mid - 1)
    return lo


def _planted(edges: dict[int, tuple[int, int]]) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("shared", pa.bool_())])

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        cols = [t[c].to_pylist() for c in ("seq", "members", "least", "sha")]
        return pa.table(nodes_of(*cols, *edges[t["shard"][0].as_py()]), schema=schema)

    return build


def trie(convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``convs`` (conv_id, turns as in ``sequences``): the columns of op12's contract."""
    members = stored(convs.select("conv_id", F.unhex(F.array_join("turns", "")).alias("turns")).withColumn("seq", F.unhex(F.left(F.sha2("turns", 256), F.lit(32)))))
    # The sequence itself rides on one of its members' rows; sums of copies are made before they are dealt out.
    one = members.groupBy("seq").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"))
    hashed = ends(members.select("seq", "conv_id"))
    one = one.join(hashed, "seq")
    ranged = one.select(F.col("turns").alias("seq"), "members", "least", "sha").repartitionByRange("seq")
    shards = stored(ranged.withColumn("shard", F.spark_partition_id()))
    # Two sequences a shard come to the driver: what neighbouring shards share depends on nothing else.
    bounds = sorted((r["lo"], r["hi"], r["shard"]) for r in shards.groupBy("shard").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect())
    common = [-1, *(_common(bytes(a[1]), bytes(b[0])) for a, b in zip(bounds, bounds[1:])), -1]
    edges = {b[2]: (common[i], common[i + 1]) for i, b in enumerate(bounds)}
    nodes = stored(shards.groupBy("shard").applyInArrow(_planted(edges), NODE))
    dropped(shards, members, hashed)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    own = F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256")
    merged = stored(nodes.where("shared").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *sums, own))
    rows = nodes.where("not shared").drop("node", "shared").unionByName(merged.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    above = F.broadcast(above) if merged.count() <= SHARED else above
    hung = rows.where("parent is not null").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return rows.where("parent is null").select(out).unionByName(hung.select(out))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    convs = stored(sequences(turns))
    out = trie(rebuilt(convs))
    dropped(convs)
    return out


_STEP = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {_STEP}), 4294967295)"
ORACLE = f"""
WITH cv AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS ts FROM conversations GROUP BY conv_id),
h AS (SELECT *, ({_CRC}) % 6 AS h FROM cv),
sq AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS s FROM h LEFT JOIN cv b ON b.conv_id = h.conv_id - h.conv_id % 100),
px AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM sq),
nd AS (SELECT md5(s[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(s[1:d - 1]::VARCHAR) END AS p, d, min(conv_id) AS c, count(*) AS m, coalesce(max(length(s[d].t)), 0) AS z, s[1:d] AS pre,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS e FROM px GROUP BY ALL),
kd AS (SELECT p AS k, count(*) AS n FROM nd WHERE p IS NOT NULL GROUP BY p),
up AS (SELECT md5(pre[1:i]::VARCHAR) AS k, sum((m - 1) * z) AS saved, count(*) FILTER (n IS NULL) AS leaves FROM (SELECT nd.*, kd.n, unnest(range(0, d + 1)) AS i FROM nd LEFT JOIN kd USING (k)) GROUP BY 1)
SELECT nd.c AS conv_id, nd.d AS depth, pa.c AS parent_conv_id, nd.m AS n_convs, coalesce(kd.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nd.e AS ends_sha256
FROM nd LEFT JOIN nd pa ON pa.k = nd.p LEFT JOIN kd ON kd.k = nd.k JOIN up ON up.k = nd.k
"""
