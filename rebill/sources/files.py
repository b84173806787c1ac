"""Statement files as lines (account_id, line_no, text): a reader, and views derived from the bank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.sources.statements import bank_rows

_HIGH = bytes(range(128, 256))
_LATIN, _CYRILLIC = _HIGH.decode("latin-1"), _HIGH.decode("cp1251", "replace")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """account_id (a hash of the path), path, line_no, text of every CSV or TXT file below ``path``; UTF-8 or else cp1251.

    An empty file is one empty line; a line break at the end begins no further line.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("\\.(csv|txt)$"))
    old = F.translate(F.decode("content", "ISO-8859-1"), _LATIN, _CYRILLIC)  # byte by byte, so no Python is needed
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).otherwise(old)
    text = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "(\r\n|\n|\r)\\z", "")
    return files.select(F.xxhash64("path").alias("account_id"), "path", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "text"))


def write_statements(lines: DataFrame, path: str) -> None:
    """Lines (account_id, line_no, text) as UTF-8 files, one an account, below a folder ``account_id=...`` of ``path``."""
    lines.repartition("account_id").sortWithinPartitions("account_id", "line_no").select("account_id", "text").write.partitionBy("account_id").text(path)


def csv_lines(s: SparkSession, d: str) -> DataFrame:
    """Bank rows as files of four layouts, some with a line before the header and broken cells; every fifth is a text dump.

    Some descriptions are quoted, with delimiters and doubled quotes in them or over two lines.
    """
    k, a = F.col("account_id") % 4, F.col("account_id")
    b = bank_rows(s, d)
    banner = (a % 3 == 1) & (k != 3)
    day = F.when(F.col("row_no") % 17 == 5, "").when(k == 1, F.date_format("date", "yyyy-MM-dd")).when(k == 2, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "dd.MM.yyyy"))
    plain = F.format_string("%.2f", "amount")
    amount = F.when(F.col("row_no") % 19 == 7, "нет").when(k == 1, plain).otherwise(F.replace(plain, F.lit("."), F.lit(",")))
    dump = F.concat(F.lit('"'), F.date_format("date", "dd.MM.yyyy"), F.lit("  "), "description", F.lit("  −"), F.format_string("%.2f", F.abs("amount")), F.lit(' ₽"'))
    name = F.when(F.col("row_no") % 13 == 4, F.concat(F.lit('"'), "description", F.lit('; ""A"", Inc\t"'))).when(
        F.col("row_no") % 29 == 11, F.concat(F.lit('"'), "description", F.lit('\n, second line"'))).otherwise(F.col("description"))
    row = F.when(a % 5 == 4, dump).when(k == 0, F.concat_ws(";", day, amount, name)).when(k == 1, F.concat_ws(",", day, amount, name)).when(
        k == 2, F.concat_ws("\t", day, name, amount)).otherwise(F.concat_ws(";", name, day, amount))
    head = F.when(a % 5 == 4, "Операции").when(k == 0, "Дата операции;Сумма (руб);Описание").when(k == 1, "date,amount,description").when(k == 2, "Дата и время\tНазначение платежа\tСписание").otherwise("Col1;Col2;Col3")
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("date", "row_no"))
    line = lambda no, t: F.struct(no.cast("int").alias("line_no"), t.alias("text"))
    own = F.transform(F.split(row, "\n"), lambda t, i: line(F.col("n") * 2 + banner.cast("int") + i, t))
    # An account's first row has the lines above it too: all lines of an account are made where its rows are.
    above = F.filter(F.array(line(F.lit(0), F.lit("Выписка по карте")), line(banner.cast("int"), head)), lambda x, i: banner | (i > 0))
    whole = F.when(F.col("n") == 1, F.concat(above, F.coalesce(own, F.array().cast("array<struct<line_no:int,text:string>>")))).otherwise(own)
    return b.withColumn("n", n).select("account_id", F.inline(whole))


def text_lines(s: SparkSession, d: str) -> DataFrame:
    """Bank rows as lines of a printed statement: three lines a row, or one for odd accounts; some are credits; a footer."""
    b = bank_rows(s, d)
    whole = F.replace(F.format_string("%.2f", F.abs("amount")), F.lit("."), F.lit(","))
    money = F.concat(F.when(F.col("row_no") % 23 == 3, "+").otherwise("−"), whole, F.lit(" ₽"))
    lines = F.when(F.col("account_id") % 2 == 1, F.array(F.concat_ws("  ", F.date_format("date", "dd.MM.yyyy"), "description", money))).otherwise(
        F.array(F.concat(F.date_format("date", "dd.MM.yy"), F.lit(" 17:04")), money, F.col("description")))
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("date", "row_no"))
    foot = F.struct(F.lit(100_000_000).alias("line_no"), F.lit("Остаток на конец периода 10 000,00 ₽").alias("text"))
    own = F.transform(lines, lambda t, p: F.struct((F.col("n") * 3 + p).alias("line_no"), t.alias("text")))
    return b.withColumn("n", n).select("account_id", F.inline(F.when(F.col("n") == 1, F.concat(own, F.array(foot))).otherwise(own)))  # the footer beside the first row
