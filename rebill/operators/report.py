"""Reports over subscriptions (one row per subscription, see ``detect``) and transactions, all per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebill.functions import dims


def totals(subs: DataFrame) -> DataFrame:
    return subs.groupBy("account_id").agg(
        F.count("*").alias("subscriptions"), F.round(F.sum("monthly_cost"), 2).alias("total_monthly"), F.round(F.sum("yearly_cost"), 2).alias("total_yearly"))


def duplicates(subs: DataFrame) -> DataFrame:
    """Known categories in which an account pays for two services or more, and what all but the cheapest cost."""
    g = subs.where((F.col("category") != dims.OTHER) & (F.col("category") != "")).groupBy("account_id", "category").agg(
        F.count("*").alias("services"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"),
        F.sum("monthly_cost").alias("m"), F.min("monthly_cost").alias("least")).where("services >= 2")
    return g.select("account_id", "category", "services", "names", F.round("m", 2).alias("monthly"), F.round(F.col("m") - F.col("least"), 2).alias("savings"), F.round((F.col("m") - F.col("least")) * 12, 2).alias("yearly_savings"))


def growth(subs: DataFrame) -> DataFrame:
    """Percent by which an account's monthly sum changed with the last prices, and its worst riser; changes below 1 % go."""
    old = F.when(F.col("old_price") > 0, F.when(F.col("period") == "ежегодно", F.col("old_price") / 12).otherwise(F.col("old_price"))).otherwise(F.col("monthly_cost"))
    riser = F.when(F.col("old_price") > 0, F.struct(F.col("percent_change").alias("p"), (-F.col("rank")).alias("r"), "name"))
    g = subs.groupBy("account_id").agg(F.round(F.sum("monthly_cost"), 2).alias("now"), F.round(F.sum(old), 2).alias("before"), F.max(riser)["name"].alias("worst"))
    g = g.where("now > 0 AND before > 0").withColumn("percent", F.floor((F.col("now") / F.col("before") - 1) * 100 + 0.5).cast("long"))
    return g.where("abs(percent) >= 1")


def _months(accounts: DataFrame, as_of: str, months: int) -> DataFrame:
    top = F.trunc(F.lit(as_of).cast("date"), "month")
    return accounts.select("account_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.add_months(top, -i))).alias("start"))


def monthly_from_txs(tx: DataFrame, subs: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """What an account really spent on its subscriptions' merchants in each of the last months; 0 where nothing."""
    names = subs.select("account_id", F.explode("merchants").alias("description")).distinct()
    spent = tx.join(names, ["account_id", "description"], "left_semi").groupBy("account_id", F.trunc("date", "month").alias("start")).agg(F.sum(F.abs("amount")).alias("s"))
    grid = _months(subs.select("account_id").distinct(), as_of, months)
    return grid.join(spent, ["account_id", "start"], "left").select("account_id", F.date_format("start", "MM.yyyy").alias("month"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


def monthly_model(subs: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Every subscription's monthly cost in each of the last months from its first charge on (240 months at most)."""
    top = F.trunc(F.lit(as_of).cast("date"), "month")
    x = subs.select("account_id", "monthly_cost", F.trunc("first_charge", "month").alias("from"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.add_months(top, -i))).alias("start"))
    live = F.months_between("start", "from").between(0, 239)
    return x.groupBy("account_id", "start").agg(F.round(F.sum(F.when(live, F.col("monthly_cost")).otherwise(0.0)), 2).alias("spent")).select("account_id", F.date_format("start", "MM.yyyy").alias("month"), "spent")


def upcoming(subs: DataFrame) -> DataFrame:
    """Active subscriptions due in an account's first two months with charges, with the sum and number of each month."""
    x = subs.where("active").withColumn("month", F.trunc("next_charge", "month"))
    x = x.withColumn("m", F.dense_rank().over(Window.partitionBy("account_id").orderBy("month"))).where("m <= 2")
    w = Window.partitionBy("account_id", "month")
    order = Window.partitionBy("account_id").orderBy("next_charge", F.desc("amount"), "rank")
    return x.select(
        "account_id", F.date_format("month", "MM.yyyy").alias("month"), "name", "next_charge", "amount", F.row_number().over(order).alias("place"),
        F.round(F.sum("amount").over(w), 2).alias("month_total"), F.count("*").over(w).alias("month_count"))


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def cancel_url(name: Column | str) -> Column:
    n = F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    return F.coalesce(_looked_up(n, dims.CANCEL), F.when(n != "", F.concat(F.lit(dims.SEARCH), F.replace(n, F.lit(" "), F.lit("+")))), F.lit(dims.SEARCH_ANY))


def enrich_links(subs: DataFrame) -> DataFrame:
    return subs.withColumn("cancel_url", cancel_url("name")).withColumn("included_in", _looked_up(F.col("name"), dims.INCLUDED))


def savings(subs: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """What an account saves a month, a year and in five years without its subscriptions, or without ``cancelled`` (account_id, id) ones."""
    x = subs if cancelled is None else subs.join(cancelled, ["account_id", "id"], "left_semi")
    m = F.sum(F.abs("monthly_cost"))
    return x.groupBy("account_id").agg(F.round(m, 2).alias("monthly"), F.round(m * 12, 2).alias("yearly"), F.round(m * 60, 2).alias("five_years"))


def days_left(subs: DataFrame, as_of: str, urgent: int = 3) -> DataFrame:
    left = F.datediff("next_charge", F.lit(as_of).cast("date"))
    return subs.select("account_id", "rank", "name", left.alias("days_left"), (left <= urgent).alias("urgent"))


def monthly_all(tx: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Signed sum of all rows of an account in each of the last months; 0 where there is none."""
    first = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), 1 - months)
    sums = tx.where(F.col("date") >= first).groupBy("account_id", F.trunc("date", "month").alias("start")).agg(F.sum("amount").alias("s"))
    grid = _months(tx.select("account_id").distinct(), as_of, months)
    return grid.join(sums, ["account_id", "start"], "left").select("account_id", F.date_format("start", "MM.yyyy").alias("month"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


def flat_series(monthly: DataFrame) -> DataFrame:
    """Whether an account spent the same in every month of a series of more than one."""
    return monthly.groupBy("account_id").agg(((F.count("*") > 1) & (F.max("spent") == F.min("spent"))).alias("flat"))


def report(tx: DataFrame, subs: DataFrame, as_of: str) -> DataFrame:
    """One row an account: its subscriptions by rank, its months in order, totals and a message.

    Accounts without a subscription get the sums of all rows as months. ``subs`` is read several times: pass a stored one.
    """
    listed = enrich_links(subs).groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "name", "category", "amount", "period", "monthly_cost", "yearly_cost", "active", "next_charge", "cancel_url", "included_in"))).alias("subscriptions"),
        F.round(F.sum(F.abs("monthly_cost")), 2).alias("total_monthly"), F.round(F.sum(F.abs("yearly_cost")), 2).alias("total_yearly"))
    spent = monthly_from_txs(tx, subs, as_of).unionByName(monthly_all(tx, as_of).join(subs.select("account_id").distinct(), "account_id", "left_anti"))
    order = F.concat(F.right("month", F.lit(4)), F.left("month", F.lit(2)))
    months = spent.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "month", "spent"))).alias("monthly"))
    rows = tx.groupBy("account_id").agg(F.count("*").alias("n")).join(months, "account_id", "left").join(listed, "account_id", "left")
    found = F.size(F.coalesce("subscriptions", F.array().cast(listed.schema["subscriptions"].dataType)))
    message = F.when(found > 0, F.concat(F.lit("Выписка: "), F.col("n"), F.lit(" транзакций, найдено подписок: "), found)).otherwise(
        F.concat(F.lit("В выписке ("), F.col("n"), F.lit(" транзакций) не найдено регулярных списаний — показаны общие расходы по выписке")))
    zero = F.lit(0.0)
    return rows.select("account_id", F.lit(False).alias("mock"), F.coalesce("subscriptions", F.array().cast(listed.schema["subscriptions"].dataType)).alias("subscriptions"), F.transform("monthly", lambda m: F.struct(m["month"], m["spent"])).alias("monthly"),
                       F.coalesce("total_monthly", zero).alias("total_monthly"), F.coalesce("total_yearly", zero).alias("total_yearly"), message.alias("message"))


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON document an account."""
    return reports.select("account_id", F.to_json(F.struct("account_id", "mock", "subscriptions", "monthly", "total_monthly", "total_yearly", "message")).alias("document"))


def write_json(reports: DataFrame, path: str) -> None:
    """One JSON text a line and account, in UTF-8."""
    report_json(reports).select("document").write.mode("overwrite").text(path)
