"""Subscriptions: groups of regular charges at a stable price.

Filters look at the descriptions of a group; only rows of groups that pass are keyed and stored, dealt out by group.
Prices and their changes are read from the sorted amounts or payments of a group, one after the other, with their counts;
what a task holds of a group is half a price level at most, not its rows. Rounding is half up. Rows without a date or an
amount take no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebill.functions import dims, text
from rebill.operators.merge import final_keys, group_items, vocabulary, with_keys
from rebill.sources.store import dropped, kept, kept_by

GROUP = ["account_id", "kind", "key"]
TOLERANCE, SAME, SHARE = 0.12, 0.05, 0.6
LEVEL = "account_id long, kind string, key string, cluster int, lo double, hi double, n long, first date, last date, newest boolean, main boolean, stable boolean, price double"


def _least_events() -> Column:
    return F.when(F.col("kind") == "brand", 2).otherwise(3)


def _hit(c: Column | str, pattern: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(text.ANY_CASE + pattern)


def drop_micro(tx: DataFrame) -> DataFrame:
    return tx.where(F.abs("amount") >= 1)


def counted(tx: DataFrame) -> DataFrame:
    """The transactions that detection looks at."""
    return drop_micro(tx).where(F.col("date").isNotNull())


def items(tx: DataFrame) -> DataFrame:
    return group_items(counted(tx))


def group_sample(keys: DataFrame) -> DataFrame:
    """The text that filters look at: the key and the group's first four descriptions, of rows as of ``final_keys``."""
    d = keys.withColumn("o", F.struct("glue", "first"))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy(*GROUP).orderBy("o"))).where("nth <= 4")
    d = d.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("o", "description"))).alias("xs"))
    return d.select(*GROUP, F.concat_ws(" ", "key", F.array_join(F.transform("xs", lambda x: x["description"]), " ")).alias("sample"))


def verdicts(keys: DataFrame, few: bool = True) -> DataFrame:
    """Every group with its number of items and why it is rejected (null: it is not), of rows as of ``final_keys``.

    Without ``few``, groups of too few items are left out, before any pattern runs on them.
    """
    g = keys.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n", "in_category", "in_code")])
    g = (g if few else g.where(F.col("n") >= _least_events())).join(group_sample(keys), GROUP)
    share = lambda c: (F.col(c) > 0) & (F.col(c) >= F.col("n") * SHARE)
    why = (
        F.when(_hit("sample", dims.INTERNAL), "internal").when(_hit("sample", dims.UTILITY), "utility").when(_hit("sample", dims.RETAIL), "retail")
        .when(_hit(F.trim("key"), dims.CITY_ONLY), "city").when(share("in_category"), "category").when(share("in_code"), "code")
        .when(F.col("n") < _least_events(), "few"))
    return g.select(*GROUP, "n", why.alias("rejected"))


class _Level:
    """Charges at one price: amounts in ascending order with their counts."""

    def __init__(self) -> None:
        self.amounts, self.counts, self.n, self.at, self.before = [], [], 0, 0, 0
        self.first = self.last = None
        self.newest = False

    def add(self, amount: float, n: int, first: object, last: object, newest: bool) -> None:
        self.amounts.append(amount)
        self.counts.append(n)
        self.n += n
        self.first, self.last = min(self.first or first, first), max(self.last or last, last)
        self.newest |= newest
        while self.before + self.counts[self.at] <= self.n // 2:  # the middle only moves up
            self.before += self.counts[self.at]
            self.at += 1

    def middle(self) -> float:
        return self.amounts[self.at]

    def price(self) -> float:
        """The upper middle without sign."""
        left = self.n - 1 - self.n // 2 if self.amounts[0] < 0 else self.n // 2
        for amount, n in zip(self.amounts, self.counts):
            if left < n:
                return abs(amount)
            left -= n
        return abs(self.amounts[-1])


def _judged(group: tuple | None, found: list[_Level]) -> list[tuple]:
    """The rows of a group's levels."""
    if not found:
        return []
    main = max(range(len(found)), key=lambda i: (found[i].n, found[i].newest, -i))
    m, price = found[main], next(x.price() for x in found if x.newest)
    enough = m.n >= (2 if group[1] == "brand" else 3)
    out = []
    for i, x in enumerate(found):
        apart = x.n >= 2 and (x.last < m.first or x.first > m.last)
        out.append((*group, i + 1, x.amounts[0], x.amounts[-1], x.n, x.first, x.last, x.newest, i == main, enough and (i == main or x.newest or apart), price))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


_KEYS = [("account_id", pa.int64()), ("kind", pa.string()), ("key", pa.string())]
_LEVELS = pa.schema([*_KEYS, ("cluster", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("first", pa.date32()), ("last", pa.date32()),
                     ("newest", pa.bool_()), ("main", pa.bool_()), ("stable", pa.bool_()), ("price", pa.float64())])
_CHANGES = pa.schema([*_KEYS, ("a", pa.float64()), ("b", pa.float64()), ("at", pa.date32())])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, found = None, []
    for b in batches:
        out = []
        for *own, amount, n, low, high, newest, nth in zip(*(b[c].to_pylist() for c in (*GROUP, "amount", "n", "low", "high", "newest", "nth"))):
            if nth == 1:
                out += _judged(group, found)
                group, found = own, []
            if not found or not abs(amount - found[-1].middle()) <= abs(found[-1].middle()) * TOLERANCE:
                found.append(_Level())
            found[-1].add(amount, n, low, high, newest)
        yield _batch(out, _LEVELS)
    yield _batch(_judged(group, found), _LEVELS)


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GROUP, amount, cluster: the number of the level that each amount joins or opens."""
    level, k = None, 0
    for b in batches:
        out = []
        for amount, n, low, high, newest, nth in zip(*(b[c].to_pylist() for c in ("amount", "n", "low", "high", "newest", "nth"))):
            k = 0 if nth == 1 else k
            if not k or not abs(amount - level.middle()) <= abs(level.middle()) * TOLERANCE:
                level, k = _Level(), k + 1
            level.add(amount, n, low, high, newest)
            out.append(k)
        yield pa.RecordBatch.from_arrays([*(b[c] for c in (*GROUP, "amount")), pa.array(out, pa.int32())], names=[*GROUP, "amount", "cluster"])


def _amounts(it: DataFrame) -> DataFrame:
    """GROUP, amount, n, low, high, newest: the distinct amounts of each group, and whether its newest charge is of it."""
    o = F.min(F.struct((-F.unix_date("date")).alias("d"), "glue", "row_no"))
    per = it.groupBy(*GROUP, "amount").agg(F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high"), o.alias("o"))
    return per.withColumn("newest", F.col("o") == F.min("o").over(Window.partitionBy(*GROUP))).drop("o")


def _in_order(it: DataFrame) -> DataFrame:
    """The same with ``nth`` of an amount in its group, in that order."""
    return _amounts(it).withColumn("nth", F.row_number().over(Window.partitionBy(*GROUP).orderBy("amount")))


def price_levels(it: DataFrame) -> DataFrame:
    """LEVEL rows: an amount joins the current level of its group within 12 % of its middle charge, else opens the next.

    The main level has most charges, of equals the newest charge's, else the lowest; stable ones are main, hold the
    newest charge, or have two charges or more wholly before or after main. Price is that of the newest charge's level.
    """
    return _in_order(it).mapInArrow(_levels, LEVEL)


def price_clusters(it: DataFrame) -> DataFrame:
    """GROUP, amount, cluster (from 1) of each distinct amount of a group."""
    return _in_order(it).mapInArrow(_clusters, "account_id long, kind string, key string, amount double, cluster int")


def stable_charges(it: DataFrame) -> DataFrame:
    """The items at stable prices with main, cluster, price and gap (days since the last one)."""
    levels = price_levels(it).where("stable").select(*GROUP, "lo", "hi", "main", "cluster", "price")
    s = it.join(levels, GROUP).where(F.col("amount").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    w = Window.partitionBy(*GROUP).orderBy("date", F.desc("main"), "cluster", "amount", "glue", "row_no")
    return s.withColumn("gap", F.datediff("date", F.lag("date").over(w)))


class _Prices:
    """Prices of a level with their counts, and the median."""

    def __init__(self) -> None:
        self.prices, self.counts, self.n = [], [], 0

    def add(self, p: float, n: int) -> None:
        i = bisect_left(self.prices, p)
        if i == len(self.prices) or self.prices[i] != p:
            self.prices.insert(i, p)
            self.counts.insert(i, 0)
        self.counts[i] += n
        self.n += n

    def _nth(self, k: int) -> float:
        for p, n in zip(self.prices, self.counts):
            if k < n:
                return p
            k -= n
        return self.prices[-1]

    def median(self) -> float:
        return (self._nth((self.n - 1) // 2) + self._nth(self.n // 2)) / 2

    def holds(self, p: float) -> bool:
        m = self.median()
        return p + m > 0 and abs(p - m) / ((p + m) / 2) <= SAME


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs of equal payments, newest first: the level that a group ends with and the one right before it.

    Once a payment fits a level, equal ones that follow do, since they draw its median nearer.
    """
    group, new, old, at, over = None, _Prices(), None, None, False

    def change() -> list[tuple]:
        return [(*group, old.median(), new.median(), at)] if old and new.n >= 2 and old.n >= 2 else []

    for b in batches:
        out = []
        for *own, p, n, after, nth in zip(*(b[c].to_pylist() for c in (*GROUP, "p", "n", "after", "nth"))):
            if nth == 1:
                out += change()
                group, new, old, at, over = own, _Prices(), None, None, False
            if over:
                continue
            if old is None and (not new.n or new.holds(p)):
                new.add(p, n)
            elif old is None:
                old, at = _Prices(), after
                old.add(p, n)
            elif old.holds(p):
                old.add(p, n)
            else:
                over = True
        yield _batch(out, _CHANGES)
    yield _batch(change(), _CHANGES)


def price_change(it: DataFrame) -> DataFrame:
    """GROUP and the last confirmed change of price: two levels of two payments or more, one right after the other."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("date"), F.desc("glue"), F.desc("row_no"))
    x = it.select(*GROUP, "date", "glue", "row_no", F.abs("amount").alias("p"))
    x = x.withColumns({"r": F.row_number().over(w), "q": F.lag("p").over(w), "after": F.lag("date").over(w), "total": F.count("*").over(Window.partitionBy(*GROUP))})
    runs = x.where(F.col("q").isNull() | (F.col("p") != F.col("q")))  # where runs of equal payments begin
    runs = runs.withColumns({"n": F.coalesce(F.lead("r").over(w), F.col("total") + 1) - F.col("r"), "nth": F.row_number().over(w)})
    both = runs.select(*GROUP, "p", "n", "after", "nth").mapInArrow(_changes, "account_id long, kind string, key string, a double, b double, at date")
    near = (F.col("a") + F.col("b") > 0) & (F.abs(F.col("a") - F.col("b")) / ((F.col("a") + F.col("b")) / 2) <= SAME)
    d = both.where(~near).withColumn("difference", F.round(F.col("b") - F.col("a"), 2))
    d = d.withColumn("percent_change", F.round(F.col("difference") / F.col("a") * 100, 2)).where(F.abs("percent_change") >= SAME * 100)
    return d.select(
        *GROUP, F.when(F.col("difference") > 0, "up").otherwise("down").alias("direction"), F.round("a", 2).alias("old_price"), F.round("b", 2).alias("new_price"),
        "difference", "percent_change", F.col("at").alias("changed_at"))


def next_charge(last: Column, months: Column, as_of: Column) -> Column:
    """The last date moved on by whole periods, one after the other, to ``as_of`` or later."""
    bound = F.greatest(F.ceil(F.months_between(as_of, last) / months) + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), bound), F.add_months(last, months), lambda d, i: F.when(d < as_of, F.add_months(d, months)).otherwise(d))


def charge_gaps(it: DataFrame) -> DataFrame:
    """GROUP, row_no, date, amount, gap: days since the stable charge before; null for the first of a group."""
    return stable_charges(it).select(*GROUP, "row_no", "date", "amount", "gap")


def newest_charge(it: DataFrame) -> DataFrame:
    """GROUP, row_no, date, amount, description of the first item, by glue and row_no, with the latest date of each group."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("date"), "glue", "row_no")
    return it.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*GROUP, "row_no", "date", "amount", "description")


def cadence(charges: DataFrame) -> DataFrame:
    """GROUP, charges, last_charge, period, months of the groups of ``stable_charges`` with a rhythm, and sums of theirs.

    The upper middle of the gaps lies in the rhythm, and 60 % of them or more do.
    """
    gap = F.col("gap")
    g = charges.groupBy(*GROUP).agg(
        F.count("*").alias("charges"), F.round(F.sum(F.abs("amount")), 2).alias("total_paid"), F.first("price").alias("price"), F.min("date").alias("first_charge"),
        F.max("date").alias("last_charge"), F.sort_array(F.collect_set("description")).alias("merchants"),
        F.max_by("description", F.struct("date", (~F.col("main")).alias("side"), "cluster", "amount", "glue", "row_no")).alias("spelling"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)").alias("mid"), F.count("gap").alias("gaps"),
        *[F.count_if(gap.between(lo, hi)).alias(f"in_{k}") for _, _, lo, hi, k in dims.PERIODS])
    g = g.where((F.col("charges") >= _least_events()) & (F.col("gaps") > 0))
    band = F.coalesce(*[F.when(F.col("mid").between(lo, hi), F.struct(F.lit(name).alias("period"), F.lit(k).alias("months"), F.col(f"in_{k}").alias("inside"))) for _, name, lo, hi, k in dims.PERIODS])
    g = g.withColumn("band", band).where(F.col("band.inside") >= F.col("gaps") * SHARE)
    return g.select(*GROUP, "charges", "total_paid", "price", "first_charge", "last_charge", "merchants", "spelling", "band.period", "band.months")


def detect_subscriptions(tx: DataFrame, as_of: str) -> DataFrame:
    """One row per subscription of an account, ranked by monthly cost: a table of its own, made before this returns.

    Keys and verdicts come from descriptions; the items of groups that pass are stored by group until the end.
    """
    day = F.lit(as_of).cast("date")
    tx = counted(tx)
    words = vocabulary(tx)
    keys = kept(final_keys(words))
    fine = kept(keys.join(verdicts(keys, few=False).where("rejected IS NULL").select(*GROUP), GROUP, "left_semi"))
    it = kept_by(with_keys(tx, fine), *GROUP)
    s = cadence(stable_charges(it))
    brand = text.canonical_brand("spelling")
    named = s.select("spelling").distinct().withColumn("named", brand)
    title = F.when(F.col("kind") == "brand", F.col("key")).otherwise(F.when(F.col("key") == "", "Подписка").otherwise(F.initcap("key")))
    s = s.join(named, "spelling").withColumn("title", title)
    s = s.withColumn("name", F.when(F.col("kind") == "brand", F.coalesce("named.name", "title")).otherwise(F.col("title"))).where(F.length(F.trim(F.coalesce("named.name", "title"))) >= 3)
    monthly = F.col("price") / F.col("months")
    seen = fine.groupBy(*GROUP).agg(F.min(F.struct("glue", "first")).alias("seen"))
    s = s.join(price_change(it), GROUP, "left").join(seen, GROUP)
    s = s.select(
        *GROUP, text.slug("title").alias("id"), "name", F.coalesce("named.category", F.lit(dims.OTHER)).alias("category"), F.coalesce("named.icon", F.lit(dims.OTHER_ICON)).alias("icon"),
        F.round("price", 2).alias("amount"), "period", F.round(monthly, 2).alias("monthly_cost"), F.round(monthly * 12, 2).alias("yearly_cost"),
        "charges", "total_paid", (F.datediff(day, "last_charge") <= F.col("months") * 62).alias("active"), "first_charge", "last_charge",
        next_charge(F.col("last_charge"), F.col("months"), day).alias("next_charge"), "merchants",
        "direction", "old_price", "new_price", "difference", "percent_change", "changed_at", "seen")
    w = Window.partitionBy("account_id").orderBy(F.desc("monthly_cost"), "seen")
    out = kept(s.withColumn("rank", F.row_number().over(w)).drop("seen"))
    dropped(words, keys, fine, it)
    return out
