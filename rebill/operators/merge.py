"""One key for all spellings of a merchant within an account.

All steps work on the distinct descriptions of an account; transactions come back by one join. Names are made from
distinct descriptions of all accounts, so that patterns run once a spelling. Null descriptions count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebill.functions import dims, text
from rebill.sources.store import dropped, kept

SIMILAR = 0.8


def vocabulary(tx: DataFrame) -> DataFrame:
    """account_id, description, kind, key, first (date, row_no), n, in_category, in_code of every distinct description.

    The table is made before this returns, and its spellings before it, so that patterns are planned and run once.
    ``in_category`` and ``in_code`` count rows whose category or code is none of subscriptions.
    """
    name = F.coalesce("description", F.lit(""))
    has = {f.name for f in tx.schema}
    column = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    v = tx.groupBy("account_id", name.alias("description")).agg(
        F.min(F.struct("date", "row_no")).alias("first"), F.count("*").alias("n"), F.count_if(column("category").rlike(text.ANY_CASE + dims.CATEGORIES)).alias("in_category"),
        F.count_if(column("mcc").isin(*dims.CODES)).alias("in_code"))
    names = kept(tx.select(name.alias("description")).distinct().withColumn("g", text.group_key("description")))
    out = kept(v.join(names, "description").select("account_id", "description", "g.kind", "g.key", "first", "n", "in_category", "in_code"))
    dropped(names)
    return out


def _tokens(names: DataFrame, least: float) -> DataFrame:
    """name, grams, tokens (t, most) of distinct names with bigrams: two names of a Dice of ``least`` or more share a token.

    Such names share n * t / (2 - t) bigrams at least, so with bigrams in one order, rare ones first, they share two
    of their first n - that + 2. Tokens are pairs of those; there are 1296 bigrams only, but many pairs. Where one
    common bigram may be enough, each is a token too, as a pair with itself. ``most`` is what the name can have in
    common with another one if the token's are the first common ones.
    """
    x = kept(names.select("name", text.bigrams("name").alias("grams"))).where(F.size("grams") > 0)
    each = x.select("name", F.explode("grams").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("df"))  # letters and digits: 1296 rows at most
    ranked = each.join(F.broadcast(counts), "w").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda s: s["w"]).alias("ws"))
    n = F.size("ws")
    common = F.ceil(n * least / (2 - least) - 1e-9)
    first = F.slice("ws", 1, (n - common + 2).cast("int"))
    token = lambda a, b, most: F.struct(F.when(a < b, F.concat(a, b)).otherwise(F.concat(b, a)).alias("t"), most.cast("int").alias("most"))
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b, k: token(a, b, n - i - k))))
    tokens = F.when(common >= 2, pairs).otherwise(F.concat(pairs, F.transform("ws", lambda w, i: token(w, w, n - i))))
    out = kept(ranked.select("name", F.array_sort("ws").alias("grams"), tokens.alias("tokens")))
    dropped(x)
    return out


def _enough(least: float) -> Column:
    """Whether names of n and m bigrams can have a Dice of ``least`` with what a common token leaves to both."""
    return F.least("most", "other_most") * 2 + 1e-9 >= (F.col("n") + F.col("m")) * least


def _resembling(names: DataFrame) -> DataFrame:
    """account_id, key, other: pairs of an account's names (account_id, key, at) that resemble each other, ``other`` before ``key``."""
    known = _tokens(names.select(F.col("key").alias("name")).distinct(), SIMILAR)
    size = F.size("grams").alias("n")
    held = names.join(known.select(F.col("name").alias("key"), size, "tokens"), "key").select("account_id", "key", "at", "n", F.inline("tokens"))
    other = held.select("account_id", "t", F.col("key").alias("other"), F.col("at").alias("before"), F.col("n").alias("m"), F.col("most").alias("other_most"))
    pairs = held.join(other, ["account_id", "t"]).where((F.col("before") < F.col("at")) & _enough(SIMILAR)).select("account_id", "key", "at", "other", "before").distinct()
    grams = known.select("name", "grams")
    both = pairs.join(grams.select(F.col("name").alias("key"), F.col("grams").alias("g")), "key").join(grams.select(F.col("name").alias("other"), F.col("grams").alias("h")), "other")
    return both.where(text.dice(F.col("g"), F.col("h")) >= SIMILAR).select("account_id", "key", "at", "other", "before")


def _first_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """account_id, key, leader of the names that join one, from pairs in order of account, name, other name."""
    account, name, joined = None, None, set()
    for b in batches:
        out = []
        for a, key, other in zip(*(b[c].to_pylist() for c in ("account_id", "key", "other"))):
            if a != account:
                account, name, joined = a, None, set()
            if key == name:
                continue  # it has joined an earlier one
            if other not in joined:
                name = key
                joined.add(key)
                out.append((a, key, other))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.string(), pa.string()))], names=["account_id", "key", "leader"])


def fuzzy_leader_merge(vocab: DataFrame) -> DataFrame:
    """account_id, key, leader, place: a name joins the first earlier leader it resembles, else it leads (place from 1).

    The walk reads an account's pairs of alike names in order and keeps the names that joined another one.
    """
    names = vocab.where("kind = 'norm'").groupBy("account_id", "key").agg(F.min("first").alias("first"))
    names = names.withColumn("at", F.struct("first", "key"))
    pairs = _resembling(names)
    # The number is not read: its window deals pairs out by account and sorts them.
    walk = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("account_id").orderBy("at", "before"))).select("account_id", "key", "other", "nth")
    joined = kept(walk.mapInArrow(_first_leaders, "account_id long, key string, leader string"))
    x = names.join(joined, ["account_id", "key"], "left").withColumn("leader", F.coalesce("leader", "key"))
    leads = x.where("leader = key").select("account_id", "leader", F.row_number().over(Window.partitionBy("account_id").orderBy("at")).alias("place"))
    return x.select("account_id", "key", "leader").join(leads, ["account_id", "leader"]).select("account_id", "key", "leader", "place")


def glue_to_brand(c: Column | str) -> Column:
    """The first brand whose squeezed name (4 letters or more) the text holds, or that holds the text (4 or more); else null."""
    brands = [(name, text.squeezed_word(name)) for name, *_ in dims.BRANDS]

    def first(s: Column) -> Column:
        return F.coalesce(*[F.when(s.contains(b) | ((F.length(s) >= 4) & F.lit(b).contains(s)), name) for name, b in brands if len(b) >= 4])

    return F.get(F.transform(F.array(text.squeezed(c)), first), F.lit(0))  # an array of one, so that the text is squeezed once


def final_keys(vocab: DataFrame) -> DataFrame:
    """The vocabulary with its final kind and key, and glue: 0, or the place of the leader that moved to a brand."""
    led = kept(fuzzy_leader_merge(vocab))
    brands = led.select("leader").distinct().withColumn("brand", glue_to_brand("leader"))
    leaders = led.join(brands, "leader").withColumnRenamed("key", "own")
    v = vocab.withColumnRenamed("key", "own").join(leaders, ["account_id", "own"], "left")
    norm = F.col("kind") == "norm"
    moved = norm & F.col("brand").isNotNull()
    return v.select(
        "account_id", "description", F.when(moved, "brand").otherwise(F.col("kind")).alias("kind"),
        F.when(moved, F.col("brand")).when(norm, F.col("leader")).otherwise(F.col("own")).alias("key"), F.when(moved, F.col("place")).otherwise(0).alias("glue"),
        "first", "n", "in_category", "in_code")


def with_keys(tx: DataFrame, keys: DataFrame) -> DataFrame:
    """Transactions with kind, key and glue of their description's row among ``keys``; those without one go."""
    return tx.withColumn("description", F.coalesce("description", F.lit(""))).join(keys.select("account_id", "description", "kind", "key", "glue"), ["account_id", "description"])


def group_items(tx: DataFrame) -> DataFrame:
    """Transactions with kind, key and glue; items of a group are ordered by glue, date, row_no."""
    return with_keys(tx, final_keys(vocabulary(tx)))


def similar_merchants(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, likeness of all pairs of different names whose bigrams have a Dice of ``least`` or more."""
    x = _tokens(names.select("name").where("name is not null").distinct(), least)
    a = x.select(F.col("name").alias("a"), F.size("grams").alias("n"), F.inline("tokens"))
    b = a.select("t", F.col("a").alias("b"), F.col("n").alias("m"), F.col("most").alias("other_most"))
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & _enough(least)).select("a", "b").distinct()
    both = pairs.join(x.select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").join(x.select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", text.dice(F.col("ga"), F.col("gb")).alias("likeness")).where(F.col("likeness") >= least)
