"""Bank transactions (account_id, row_no, date, amount, description, category, mcc) derived from the customer and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOPS = ("CORNER SHOP", "BOOK HOUSE", "CITY CAFE")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as single purchases."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_custkey").cast("long").alias("account_id"), (F.col("o_orderkey") + 1000).cast("long").alias("row_no"),
        F.date_add(F.lit("2025-01-01").cast("date"), F.dayofyear("o_orderdate") - 1).alias("date"),
        (-F.floor(F.col("o_totalprice") % 3000 + 150)).cast("double").alias("amount"),
        F.get(F.array(*map(F.lit, SHOPS)), (F.col("o_orderkey") % 3).cast("int")).alias("description"))


# Monthly and other charges: first day, days between, charges, price, spellings, category, code.
SLOTS = (
    ("2025-01-03", 30, 14, 599.0, ("NETFLIX.COM 866-579-7172 US", "NFLX* 8NQ4R2"), None, None),
    ("2025-01-05", 30, 14, 299.0, ("YNDX_PLUS PAYMENT", "ЯНДЕКС ПЛЮС"), None, None),
    ("2025-01-07", 30, 13, 450.0, ("CLOUD BOX 20 MSK", "Оплата CLOUD BOX MSK"), None, None),
    ("2025-01-09", 30, 14, 350.0, ("KARAVANA STORE ONE", "KARAVANA STORES ONE"), None, None),
    ("2025-01-11", 30, 12, 199.0, ("MORE TV SUB", "MORE.TV 77"), None, None),
    ("2025-01-13", 91, 5, 1500.0, ("FIT LINE CLUB",), None, None),
    ("2024-06-15", 182, 4, 2400.0, ("DOMAIN HOST",), None, None),
    ("2022-01-17", 365, 5, 3990.0, ("ANTIVIR KEY",), None, None),
    ("2025-01-02", 7, 20, 90.0, ("DAILY NEWS BOX",), None, None),
    ("2025-01-19", 30, 14, 800.0, ("ЖКХ УСЛУГИ",), None, None),
    ("2025-01-20", 30, 14, 640.0, ("PYATEROCHKA 2451",), None, None),
    ("2025-01-21", 30, 14, 5000.0, ("Перевод СБП",), None, None),
    ("2025-01-22", 30, 14, 410.0, ("MOSCOW RUS",), None, None),
    ("2025-01-23", 30, 14, 120.0, ("123456", "123457"), None, None),
    ("2025-01-24", 30, 14, 700.0, ("EVENING BAR",), "Рестораны и кафе", None),
    ("2025-01-25", 30, 14, 730.0, ("CORNER NOOK",), None, "5814"),
    ("2025-01-26", 30, 14, 0.5, ("ROUND UP",), None, None),
    ("2025-01-27", 30, 14, 249.0, ("SPOTIFY AB", "SPOT* AB"), None, None),
    ("2025-01-28", 30, 14, 269.0, ("ОККО ПОДПИСКА",), None, None),
    ("2025-01-29", 30, 14, 590.0, ("FIGMA MONTHLY RENEWAL",), None, None),
)
AS_OF = "2026-03-01"


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, row_no, date, amount, description, category, mcc: charges of SLOTS and the orders as single purchases.

    A customer gives some sixty rows, so customers are dealt out first: a small file would else be one task.
    """
    slots = F.array(*[
        F.struct(
            F.lit(i).alias("s"), F.lit(day).cast("date").alias("day"), F.lit(step).alias("step"), F.lit(n).alias("n"), F.lit(price).alias("price"),
            F.array(*map(F.lit, names)).alias("names"), F.lit(category).cast("string").alias("category"), F.lit(mcc).cast("string").alias("mcc"))
        for i, (day, step, n, price, names, category, mcc) in enumerate(SLOTS)])
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("a"))
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = c.select("a", F.inline(slots)).where("(a + s) % 4 = 0").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("(a * 7 + s * 3 + m) % 11 <> 0")
    price = F.when((F.col("a") % 3 == 0) & (F.col("m") >= 7), F.round(F.col("price") * 1.4, 2)).otherwise(F.col("price"))
    charges = c.select(
        F.col("a").alias("account_id"), (F.col("s") * 100 + F.col("m")).cast("long").alias("row_no"),
        F.date_add("day", (F.col("m") * F.col("step") + (F.col("a") + F.col("m")) % 3 - 1).cast("int")).alias("date"),
        (-price).alias("amount"), F.get("names", F.col("m") % F.size("names")).alias("description"), "category", "mcc")
    bought = purchases(spark, sf_dir)
    return charges.unionByName(bought.withColumn("category", F.lit(None).cast("string")).withColumn("mcc", F.lit(None).cast("string")))


def _sql(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


BANK_SQL = "WITH bank AS (SELECT a AS account_id, CAST(s * 100 + m AS BIGINT) AS row_no, CAST(day AS DATE) + CAST(m * step + (a + m) % 3 - 1 AS INT) AS date,\n" + """
  -(CASE WHEN a % 3 = 0 AND m >= 7 THEN round(price::DOUBLE * 1.4::DOUBLE, 2) ELSE price::DOUBLE END) AS amount,
  names[m % len(names) + 1] AS description, category, mcc
 FROM (SELECT CAST(c_custkey AS BIGINT) a FROM customer), (VALUES """ + ", ".join(
    f"({i}, {_sql(d)}, {step}, {n}, {price}, [{', '.join(map(_sql, names))}], {_sql(cat)}, {_sql(mcc)})" for i, (d, step, n, price, names, cat, mcc) in enumerate(SLOTS)
) + """) v(s, day, step, n, price, names, category, mcc), (SELECT unnest(range(0, 20)) m)
 WHERE (a + s) % 4 = 0 AND m < n AND (a * 7 + s * 3 + m) % 11 <> 0
 UNION ALL SELECT CAST(o_custkey AS BIGINT), CAST(o_orderkey + 1000 AS BIGINT), DATE '2025-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INT),
  -CAST(floor(o_totalprice % 3000 + 150) AS DOUBLE), ['CORNER SHOP', 'BOOK HOUSE', 'CITY CAFE'][CAST(o_orderkey % 3 AS INT) + 1], NULL, NULL FROM orders)
"""
