"""Links between sets that share a band bucket, confirmed on the full sets, and their components.

Buckets are never expanded into pairs. First every class is held against centres of its buckets, in rounds in which
what is already linked counts as one. What is then still apart from the largest component of a bucket is
joined by an exact prefix filter: with shingles in order of their frequency, two sets of the wanted likeness share one of
their rarest ones, and the place of the first shared one bounds what they can have in common. So does a parity sketch: the
bits in which two sketches differ are at most the shingles that only one of the sets has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebill.llm.common import components, dropped, stored

ROUNDS, TRIES = 4, 2  # rounds of centres; centres that a component tries in a round
LONGS = 8  # of a parity sketch; it tells sets of up to some 700 shingles at 0.7 from those at 0.8, larger ones less well


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * intersection >= percent * union of their sets (node, set)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _mixed(inside: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """bucket, node, root, c, major of the buckets that hold several roots; c is a node of the largest, major."""
    tagged = inside.withColumn("root", F.col("node")) if roots is None else inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tagged = stored(tagged.select("bucket", "node", "root"))
    pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("c")))
    sizes = tagged.groupBy("bucket", "root").agg(F.count("*").alias("n"), pick.alias("m"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "m", F.col("root").alias("major"))).alias("m"), F.count("*").alias("roots"))
    tops = tops.where("roots > 1").select("bucket", "m.m.c", "m.major")
    out = stored(tagged.join(tops, "bucket"))
    dropped(tagged)
    return out


def sketched(rows: DataFrame) -> DataFrame:
    """node and its parity sketch p0, p1, ...: each shingle of ``rows`` (node, token) turns one bit."""
    place = F.shiftrightunsigned("token", 6) % LONGS
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    return rows.groupBy("node").agg(*[F.coalesce(F.bit_xor(F.when(place == i, bit)), F.lit(0).cast("long")).alias(f"p{i}") for i in range(LONGS)])


def link(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the nodes that reach a smaller one through confirmed links; ``inside`` has bucket, node."""
    links, roots, turn = None, None, 0
    while True:
        mixed = _mixed(inside, roots, turn)
        if turn == ROUNDS:
            break
        near = mixed.where("root <> major").groupBy("root", F.col("node").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n"))
        best = Window.partitionBy("root").orderBy(F.desc("n"), F.xxhash64("b"), "a", "b")
        near = stored(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIES).select("a", "b"))
        new = stored(confirmed(near, sets, percent))
        dropped(near)
        if new.isEmpty():
            break
        links = new if links is None else stored(links.unionByName(new))
        roots = components(links)
        dropped(mixed)
        turn += 1
    least = F.ceil(F.col("n") * percent / 100)
    nodes = mixed.groupBy("node", "root").agg(F.max(F.col("root") != F.col("major")).alias("minor"))
    held = nodes.join(sets, "node").withColumn("n", F.size("set"))
    rows = stored(held.select("node", "root", "minor", "n", F.explode("set").alias("token")))
    dropped(mixed)
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("node").orderBy("df", "token")
    # A shingle of one set alone takes its place in the order but can be shared with none.
    placed = rows.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("pos", F.row_number().over(order))
    early = stored(placed.where((F.col("pos") <= F.col("n") - least + 1) & (F.col("df") > 1)).select("token", "node", "root", "minor", "n", "pos"))
    # A shingle of one component, or of none that is apart from a larger one, makes no pair.
    met = early.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("minor").alias("any")).where("lo <> hi and any")
    placed = stored(early.join(met.select("token"), "token").join(sketched(rows), "node"))
    dropped(rows, early)
    sketch = [f"p{i}" for i in range(LONGS)]
    a = placed.where("minor").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "pos", *sketch)])
    b = placed.select("token", "minor", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "pos", *sketch)])
    most = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fits = most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch])
    alike = (F.col("n_a") + F.col("n_b") - apart) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * (2 * percent)
    once = ~F.col("minor") | (F.col("node_a") < F.col("node_b"))
    pairs = stored(a.join(b, "token").where((F.col("root_a") != F.col("root_b")) & fits & once & alike).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    more = stored(confirmed(pairs, sets, percent))
    dropped(placed, pairs)
    if not more.isEmpty() or roots is None:
        roots = components(more if links is None else links.unionByName(more))
    return roots
