"""What queries over larger tables rest on: how work is dealt out, and that heavy expressions are there once."""

from datetime import date

from pyspark.sql import functions as F

from rebill.operators import detect, lines, tables
from rebill.plans import files
from rebill.sources.statements import bank_rows

D = "/root/testdata/sf0.001"


def patterns(frame):
    """How many regular expressions the plan of a frame runs."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(f) for f in ("regexp_replace(", "regexp_extract(", "regexp_extract_all(", "RLIKE"))


def test_charges_of_one_small_file_are_dealt_out(spark):
    charges = bank_rows(spark, D).where("row_no < 1000")
    assert charges.select(F.spark_partition_id()).distinct().count() > 1


def test_cell_numbers(spark):
    cases = {
        "1 234,5": 1234.5, "-1.234,56 ₽": -1234.56, "−1.234.567,08руб.": -1234567.08, "+7": 7.0, "1,234": 1234.0, ".5": 0.5, "5.": None, "--5": None, "x1": None,
        "1,,3": 1.3, "12,3": 12.3, "1.2.34": 12.34, "": None, None: None, "7 rub": 7.0, "-": None, "0,07": 0.07}
    x = spark.createDataFrame([(k,) for k in cases], "cell string").repartition(2).select("cell", lines.cell_number("cell").alias("n"))
    assert {r["cell"]: r["n"] for r in x.collect()} == cases
    assert patterns(x) == 2


def test_merchants_are_searched_once(spark):
    x = spark.createDataFrame([("1,00 RUB, SHOP, x", 1.0)], "d string, a double").repartition(2)
    assert patterns(x.select(tables.extract_merchant("d", "a").alias("m"))) <= 12


def test_price_clusters_read_their_items_once(spark):
    it = spark.createDataFrame([(1, "norm", "k", date(2026, 1, i + 1), a, 0, i) for i, a in enumerate((-1.0, -1.05, -2.0, -2.0))], "account_id long, kind string, key string, date date, amount double, glue int, row_no int")
    x = detect.price_clusters(it)
    assert sorted((r["amount"], r["cluster"]) for r in x.collect()) == [(-2.0, 1), (-1.05, 2), (-1.0, 2)]
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_files_stay_where_their_accounts_are(spark):
    def moves(name):
        plan = files.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning(")

    assert moves("csv_lines") == 1
    assert moves("single_column_dump") <= 3  # the bank rows, once for each of the lines that a query reads


def test_tables_stay_where_their_accounts_are(spark):
    from rebill.plans import tables as plans

    plan = plans.QUERIES["assign_cells"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 3  # the bank rows, once for each time that lines are read
