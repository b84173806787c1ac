"""Document fingerprints (native): 64-bit SimHash with permuted block tables.

Null texts count as empty; an empty text has the fingerprint of no terms (all bits 0). Equal texts get equal
fingerprints. Extra columns are ignored; rows that repeat a doc_id are rows of their own, next to each other in no fixed
order. Rows with a null doc_id come last, before the first again.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import read, stored

_PAIR = 4294967297  # bits i and i + 32 of a hash, counted in the halves of one long


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``fp`` (long): each word pair votes on 64 signed bits, as often as it occurs."""
    ws = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\x20\x09-\x0D]+", " ")), " ")
    pairs = F.zip_with(ws, F.slice(ws, 2, 2147483647), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(""))))
    none = F.array(F.lit(None).cast("long"))  # one null term keeps empty texts
    terms = df.select(*keys, F.explode(F.when(F.col(text) == "", none).otherwise(pairs)).alias("h"))
    counts = terms.groupBy(*keys).agg(
        F.count("h").alias("n"),
        *[F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR))), F.lit(0)).alias(f"c{i}") for i in range(32)],
    )
    bits = []
    for i in range(32):
        low, high = F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"c{i}", 32)
        bits.append(F.when(low * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        top = (1 << (i + 32)) if i < 31 else -(1 << 63)
        bits.append(F.when(high * 2 > F.col("n"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return counts.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def likeness(a: str, b: str):
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def _bits(low: int, high: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def near_pairs(fps: DataFrame, radius: int = 3, hot: int = 256) -> DataFrame:
    """All pairs (fp_a < fp_b) of distinct fingerprints within ``radius`` bits, through permuted block tables.

    Of 2 * radius blocks two fingerprints within the radius agree on ``radius`` at least, so every choice of these is a
    table. Keys of more than ``hot`` fingerprints are split by one more of radius + 1 blocks of the whole, on one of which
    the pair agrees, too. Equal fingerprints are one row, so copies make no pairs; any pair is made once.
    """
    n = max(2 * radius, 1)
    edges = [64 * i // n for i in range(n + 1)]
    tables = list(combinations(range(n), radius))
    keys = F.array(*[F.struct(F.lit(i).alias("no"), F.xxhash64(F.lit(i), *[_bits(edges[j], edges[j + 1]) for j in t]).alias("bits")) for i, t in enumerate(tables)])
    t = stored(fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.no", "k.bits"))
    sizes = t.groupBy("no", "bits").count().where("count > 1")
    t = stored(t.join(sizes, ["no", "bits"]))
    # The bits outside of a table's blocks differ in radius places at most: one of radius + 1 parts of them agrees.
    out, places = [], []
    for chosen in tables:
        free = [b for j in range(n) if j not in chosen for b in range(edges[j], edges[j + 1])]
        parts = [free[len(free) * r // (radius + 1):len(free) * (r + 1) // (radius + 1)] for r in range(radius + 1)]
        masks = [sum(1 << b for b in x) for x in parts]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        places.append(masks)
        out.append(F.array(*[F.struct(F.lit(r).alias("r"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("more")) for r, m in enumerate(masks)]))
    split = F.element_at(F.array(*out), F.col("no") + 1)
    whole = F.array(F.struct(F.lit(-1).alias("r"), F.lit(0).cast("long").alias("more")))
    t = stored(t.select("fp", "no", "bits", F.explode(F.when(F.col("count") > hot, split).otherwise(whole)).alias("x")).select("fp", "no", "bits", "x.*"))
    on = ["no", "bits", "r", "more"]
    a, b = t.withColumnRenamed("fp", "fp_a"), t.withColumnRenamed("fp", "fp_b")
    apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    near = F.bit_count(apart)
    # A pair agrees on the keys of several tables; the first of them is the one that gives it.
    masks = [sum(1 << bit for j in chosen for bit in range(edges[j], edges[j + 1])) for chosen in tables]
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")) == 0, i) for i, m in enumerate(masks)])
    # So does the first part, of those that split a hot key.
    part = lambda r: F.element_at(F.array(*[F.lit(x[r]).cast("long") for x in places]), F.col("no") + 1)
    for r in range(radius):
        first = F.when((F.col("r") <= r) | (apart.bitwiseAND(part(r)) != 0), first)
    return a.join(b, on).where((F.col("fp_a") < F.col("fp_b")) & (near <= radius) & (F.col("no") == first)).select("fp_a", "fp_b", near.alias("distance"))


def near_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fp, near_fingerprints (other fingerprints within ``radius``) and near_rows (other rows with these or the same)."""
    classes = stored(fps.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")))
    pairs = stored(near_pairs(classes, radius).select("fp_a", "fp_b"))
    both = pairs.unionByName(pairs.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b")))
    sums = both.join(classes.withColumnRenamed("fp", "fp_b"), "fp_b").groupBy(F.col("fp_a").alias("fp")).agg(F.count("*").alias("c"), F.sum("n").alias("r"))
    zero = F.lit(0).cast("long")
    return classes.join(sums, "fp", "left").select("fp", F.coalesce("c", zero).alias("near_fingerprints"), (F.coalesce("r", zero) + F.col("n") - 1).alias("near_rows"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``next_id`` and ``next_text`` in descending doc_id order, the last with the first, and (p, nth) of each row.

    doc_ids are dealt into ranges by percentiles; the first row of each range is copied into the range before
    it, so that each lead() stays in its range and texts are shuffled once. One document is its own next.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))  # null ids are below all others
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100000)).first()[0]
    cuts = sorted(set(cuts or []))
    lit = F.array(*[F.lit(c).cast("long") for c in cuts])
    part = F.size(F.filter(lit, lambda c: c < F.col("k"))) if cuts else F.lit(0)
    docs = docs.withColumn("part", part)
    firsts = [tuple(r) for r in docs.groupBy("part").agg(F.max("k").alias("m")).orderBy(F.desc("part")).collect()]
    if not firsts:
        return docs.select("doc_id", "text", "part", F.lit(1).alias("nth"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")).withColumnRenamed("part", "p")
    # The highest row of each range also ends the range above it; the very first also ends the lowest range.
    ends = {m: (firsts[i - 1][0]) for i, (_, m) in enumerate(firsts)}
    to = F.create_map(*[F.lit(x) for m, p in ends.items() for x in (m, p)])[F.col("k")]
    rows = docs.select(
        "doc_id", "k", "text",
        F.explode(F.when(to.isNotNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("x")), F.struct(to.alias("p"), F.lit(1).alias("x"))))
                  .otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("x"))))).alias("at"),
    ).select("doc_id", "k", "text", "at.p", "at.x")
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy(F.col("x"), F.desc("k"))
    return rows.select("doc_id", "text", "x", "p", F.row_number().over(w).alias("nth"), F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text")).where("x = 0").drop("x")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.col("text").substr(F.lit(1), F.length("text") - half)
    rows = with_next(docs).withColumn("edited", F.concat(head, F.col("next_text").substr(F.lit(1), half)))
    kinds = [F.struct(F.lit(v).alias("v"), F.col(c).alias("t")) for v, c in enumerate(("text", "edited", "next_text"))]
    row = ["doc_id", "p", "nth", "n_chars", "edited_sha256"]
    meta = rows.select("doc_id", "p", "nth", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(*kinds)).alias("e"))
    fps = fingerprints(meta.select(*row, "e.v", F.col("e.t").alias("text")), [*row, "v"])
    one = stored(fps.groupBy(*row).agg(*[F.max(F.when(F.col("v") == v, F.col("fp"))).alias(c) for v, c in enumerate(("fp", "efp", "nfp"))]))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    counted = stored(near_counts(one.select("fp")))
    return one.join(counted, "fp").select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"), "near_fingerprints", "near_rows")
