"""Queries over statement files and printed statements, reports and states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.functions import layout, letters, text
from rebill.operators import ingest, lines, merge, report, state
from rebill.plans import oracles, subscriptions
from rebill.plans.oracles import _q
from rebill.sources.files import csv_lines, read_statements, text_lines, write_statements
from rebill.sources.statements import AS_OF, BANK_SQL, bank_rows
from rebill.sources.store import kept, kept_by, shared_path


def _head(s: SparkSession, d: str) -> DataFrame:
    return ingest.find_header_line(csv_lines(s, d))


def _delims(s: SparkSession, d: str) -> DataFrame:
    return ingest.detect_delimiter(csv_lines(s, d), _head(s, d))


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Rows with cells of the derived files."""
    return ingest.statement_rows(csv_lines(s, d))


def _file_cells(s: SparkSession, d: str) -> DataFrame:
    return ingest.row_cells(_rows(s, d))


def _kept_rows(s: SparkSession, d: str) -> DataFrame:
    return kept_by(_rows(s, d), "account_id", dealt=True)


def _parsed(rows: DataFrame) -> DataFrame:
    return ingest.parse_records(rows, ingest.row_columns(rows))


def _guessed(s: SparkSession, d: str) -> DataFrame:
    return ingest.row_columns(_rows(s, d))


def _dumped(rows: DataFrame) -> DataFrame:
    """Transactions of the files that are text dumps."""
    dump = ingest.row_dump(rows)
    return lines.direction_lines(lines.assemble_lines(dump)).select("account_id", "row_no", "date", "amount", "description")


def _united(s: SparkSession, d: str) -> DataFrame:
    rows = _kept_rows(s, d)
    return lines.union_sources(kept(_parsed(rows).drop("row_no")), _dumped(rows).drop("row_no"))


def _scan(s: SparkSession, d: str) -> DataFrame:
    x = text_lines(s, d).withColumn("found", lines.money_scan("text"))
    return x.select("account_id", "line_no", F.size("found").alias("n"), F.get("found", F.lit(0))["sign"].alias("sign"), F.get("found", F.lit(0))["value"].alias("value"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    n, k = F.format_string("%.2f", F.abs("amount")), F.col("row_no") % 4
    cell = F.when(k == 0, n).when(k == 1, F.concat(F.replace(n, F.lit("."), F.lit(",")), F.lit(" ₽"))).when(k == 2, F.concat(F.lit("−1.234.567,"), F.right(n, F.lit(2)), F.lit("руб."))).otherwise(F.concat(F.lit("x"), n))
    return bank_rows(s, d).select("account_id", "row_no", cell.alias("cell")).withColumn("number", lines.cell_number("cell"))


def _report(s: SparkSession, d: str) -> DataFrame:
    return report.report(bank_rows(s, d), subscriptions._subs(s, d), AS_OF)


def _flat(reports: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("subscriptions", lambda x: x["name"]), "|")
    months = F.array_join(F.transform("monthly", lambda m: F.concat(m["month"], F.lit("="), F.format_string("%.2f", m["spent"]))), "|")
    return reports.select("account_id", names.alias("subscriptions"), months.alias("monthly"), "total_monthly", "total_yearly", "message")


def _written(s: SparkSession, d: str) -> DataFrame:
    """The reports as read back from their JSON texts."""
    reports, path = _report(s, d), shared_path(s)
    report.write_json(reports, path)
    return _flat(s.read.schema(reports.schema).json(path))


def _read(s: SparkSession, d: str) -> DataFrame:
    """The derived files, written and read back."""
    path = shared_path(s)
    write_statements(csv_lines(s, d), path)
    return read_statements(s, path).select(F.regexp_extract("path", "account_id=(-?\\d+)", 1).cast("long").alias("account_id"), "line_no", "text")


def _unread(s: SparkSession, d: str) -> DataFrame:
    """Files cut to their header, to other headers, or to nothing for some accounts, and why they can't be read."""
    a = F.col("account_id")
    x = csv_lines(s, d).where((a % 5 != 4) & ((a % 7 != 0) | (F.col("line_no") <= 1)))
    x = x.withColumn("text", F.when(a % 7 == 0, "").when((a % 11 == 0) & (F.col("line_no") > 1), "-,-").when((a % 11 == 0) & (a % 2 == 0), "date,bar").when(a % 11 == 0, "foo,memo").otherwise(F.col("text")))
    head = ingest.find_header_line(x)
    cell = ingest.statement_cells(x, head, ingest.detect_delimiter(x, head))
    return ingest.unreadable(head, ingest.guess_columns(cell, ingest.pick_columns(cell)))


def _saved(s: SparkSession, d: str) -> DataFrame:
    """States saved in three turns, the second of them twice, and loaded."""
    path, states = shared_path(s), _states(s, d)
    for turn in (0, 1, 1, 2):
        state.save(states.where(F.pmod(F.unix_date(F.col("analyzed_at").cast("date")), F.lit(3)) == turn), path)
    return state.load(s, path)


def _states(s: SparkSession, d: str) -> DataFrame:
    """A state a bank row: its description as the payload, none for some."""
    return bank_rows(s, d).select("account_id", F.col("date").cast("timestamp").alias("analyzed_at"), F.when(F.col("row_no") % 7 != 3, F.col("description")).alias("payload"))


def _savings(s: SparkSession, d: str) -> DataFrame:
    subs = subscriptions._subs(s, d)
    return report.savings(subs, subs.where("rank % 2 = 0").select("account_id", "id").distinct())


def _merchants(s: SparkSession, d: str) -> DataFrame:
    """Names of the bank rows, and two made-up ones a customer, of which one lacks the last letters of the other."""
    made = s.read.parquet(f"{d}/customer.parquet").select(F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789", "GHIJKLMNOP").alias("m"))
    made = made.select(F.explode(F.array(F.upper(F.left("m", F.lit(16))), F.upper(F.left("m", F.lit(14))))).alias("name"))
    return bank_rows(s, d).select(text.normalize_description("description").alias("name")).unionByName(made).distinct()


def _top_names(s: SparkSession, d: str) -> DataFrame:
    return bank_rows(s, d).groupBy("description").agg(F.max(F.when(F.col("row_no") % 3 == 0, F.abs("amount"))).alias("amount"))


QUERIES = {
    "csv_lines": csv_lines,
    "find_header_line": _head,
    "detect_delimiter": _delims,
    "pick_columns": lambda s, d: ingest.pick_columns(_file_cells(s, d)),
    "guess_columns": _guessed,
    "parse_rows": lambda s, d: _parsed(_kept_rows(s, d)),
    "single_column_dump": lambda s, d: ingest.row_dump(_rows(s, d)),
    "dump_transactions": lambda s, d: _dumped(_rows(s, d)),
    "union_sources": _united,
    "column_role": lambda s, d: _file_cells(s, d).where("row_no = 0").select("account_id", "col_no", "value", lines.column_role(F.col("value")).alias("role")),
    "text_lines": text_lines,
    "mask_non_money": lambda s, d: text_lines(s, d).select("account_id", "line_no", lines.mask_non_money("text").alias("masked")),
    "money_scan": _scan,
    "pick_amount": lambda s, d: text_lines(s, d).select("account_id", "line_no", lines.pick_amount(lines.money_scan("text"))["value"].alias("amount")),
    "line_text": lambda s, d: lines.scanned(text_lines(s, d)).select("account_id", "line_no", "rest"),
    "clean_desc": lambda s, d: bank_rows(s, d).select("description").distinct().select("description", lines.clean_desc("description").alias("cleaned")),
    "assemble_lines": lambda s, d: lines.assemble_lines(text_lines(s, d)),
    "direction_lines": lambda s, d: lines.direction_lines(lines.assemble_lines(text_lines(s, d))),
    "cell_number": _cells,
    "similar_merchants": lambda s, d: merge.similar_merchants(_merchants(s, d)),
    "letter": lambda s, d: _top_names(s, d).select("description", letters.letter(F.when(F.col("description").contains("FIGMA"), " Figma ").otherwise(F.col("description")), "amount", AS_OF).alias("letter")),
    "latest_state": _saved,
    "monthly_all": lambda s, d: report.monthly_all(bank_rows(s, d), AS_OF),
    "days_left": lambda s, d: report.days_left(subscriptions._subs(s, d), AS_OF),
    "flat_series": lambda s, d: report.flat_series(report.monthly_from_txs(bank_rows(s, d), subscriptions._subs(s, d), AS_OF)),
    "savings": _savings,
    "report": lambda s, d: _flat(_report(s, d)),
    "report_json": _written,
    "read_statements": _read,
    "unreadable": _unread,
}

_K = "account_id % 4"
_DAY = "CASE WHEN row_no % 17 = 5 THEN '' WHEN k = 1 THEN strftime(date, '%Y-%m-%d') WHEN k = 2 THEN strftime(date, '%d/%m/%Y') ELSE strftime(date, '%d.%m.%Y') END"
_AMOUNT = "CASE WHEN row_no % 19 = 7 THEN 'нет' WHEN k = 1 THEN printf('%.2f', amount) ELSE replace(printf('%.2f', amount), '.', ',') END"
_NAMED = "CASE WHEN row_no % 13 = 4 THEN '\"' || description || '; \"\"A\"\", Inc' || chr(9) || '\"' WHEN row_no % 29 = 11 THEN '\"' || description || chr(10) || ', second line\"' ELSE description END"
_CSV = f"""bb AS (SELECT *, {_K} AS k, row_number() OVER (PARTITION BY account_id ORDER BY date, row_no) * 2 AS n FROM bank),
b AS (SELECT * REPLACE ({_NAMED} AS description), description AS plain, {_DAY} AS dd, {_AMOUNT} AS aa FROM bb), heads AS (SELECT DISTINCT account_id, {_K} AS k FROM bank),
br AS (SELECT account_id, n + (account_id % 3 = 1 AND k <> 3)::INT AS n, string_split(CASE WHEN account_id % 5 = 4 THEN '"' || strftime(date, '%d.%m.%Y') || '  ' || plain || '  −' || printf('%.2f', abs(amount)) || ' ₽"'
  WHEN k = 0 THEN dd || ';' || aa || ';' || description WHEN k = 1 THEN dd || ',' || aa || ',' || description WHEN k = 2 THEN dd || chr(9) || description || chr(9) || aa ELSE description || ';' || dd || ';' || aa END, chr(10)) AS ls FROM b),
cl AS (SELECT account_id, CAST(n + i - 1 AS INT) AS line_no, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM br)
 UNION ALL SELECT account_id, (account_id % 3 = 1 AND k <> 3)::INT, CASE WHEN account_id % 5 = 4 THEN 'Операции' WHEN k = 0 THEN 'Дата операции;Сумма (руб);Описание' WHEN k = 1 THEN 'date,amount,description'
  WHEN k = 2 THEN 'Дата и время' || chr(9) || 'Назначение платежа' || chr(9) || 'Списание' ELSE 'Col1;Col2;Col3' END FROM heads
 UNION ALL SELECT account_id, 0, 'Выписка по карте' FROM heads WHERE account_id % 3 = 1 AND k <> 3),"""


def _cut(d: str) -> str:
    """Cells of a record, quotes and all; for the well-formed ones above."""
    return f"CASE WHEN contains(text, '\"') THEN regexp_extract_all(text || {d}, '(\"(?:[^\"]|\"\")*\"|[^\"' || {d} || '][^' || {d} || ']*|)' || {d}, 1) ELSE string_split(text, {d}) END"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ё', 'е'), '\\(.*?\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _kinds(d: str) -> str:
    names = f"list_transform(string_split(text, {d}), lambda c: {_norm('c')})"
    some = " + ".join(f"(len(list_filter({names}, lambda n: {' OR '.join(f'contains(n, {_q(a)})' for a in al)})) > 0)::INT" for al in layout.ALIASES.values())
    return f"CASE WHEN len(string_split(text, {d})) < 2 THEN 0 ELSE {some} END"


_SEPS = ("';'", "chr(9)", "','")
_EVEN = " ".join(f"WHEN min(len({_cut(d)})) > 1 AND min(len({_cut(d)})) = max(len({_cut(d)})) THEN {d}" for d in _SEPS)
_KIND_ROWS = ", ".join(f"({_q(k)}, [{', '.join(map(_q, al))}])" for k, al in layout.ALIASES.items())


def _best(kind: str, i: int) -> str:
    """Columns guessed for a kind, as g<i>, after those of earlier kinds."""
    taken = "SELECT account_id, col_no FROM pick" + "".join(f" UNION ALL SELECT account_id, col_no FROM g{j}" for j in range(i))
    return (f"g{i} AS (SELECT account_id, '{kind}' AS kind, col_no FROM stats s WHERE {kind} > 0 AND account_id NOT IN (SELECT account_id FROM pick WHERE kind = '{kind}') "
            f"AND (account_id, col_no) NOT IN ({taken}) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY {kind} DESC, col_no) = 1),")


_NUMBER = "TRY_CAST(replace(regexp_replace(value, '[^0-9.,-]', '', 'g'), ',', '.') AS DOUBLE)"
_FILES = BANK_SQL + ", " + _CSV + f"""
hd AS (SELECT account_id, line_no, text, CAST(kinds AS INT) AS kinds FROM (SELECT *, greatest({', '.join(map(_kinds, _SEPS))}) AS kinds FROM cl WHERE line_no < 15)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY least(kinds, 2) DESC, line_no) = 1),
body AS (SELECT cl.*, h.line_no AS h, sum(length(cl.text) + 1) OVER w - length(cl.text) - 1 AS before, coalesce(sum(length(cl.text) - length(replace(cl.text, '"', ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS goes_on
  FROM cl JOIN hd h USING (account_id) WHERE cl.line_no >= h.line_no WINDOW w AS (PARTITION BY account_id ORDER BY cl.line_no)),
rc AS (SELECT account_id, string_agg(text, chr(10) ORDER BY line_no) AS text, min(before) AS before, string_agg(text, chr(10) ORDER BY line_no) FILTER (before < 4096) AS sniffed, row_number() OVER (PARTITION BY account_id ORDER BY rec) - 1 AS row_no
  FROM (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY account_id ORDER BY line_no) AS rec FROM body) GROUP BY account_id, rec),
dl AS (SELECT account_id, CASE {_EVEN} ELSE ',' END AS delimiter FROM (SELECT account_id, sniffed AS text FROM rc WHERE before < 4096) GROUP BY account_id),
cut AS (SELECT account_id, row_no, CASE delimiter WHEN ';' THEN {_cut("';'")} WHEN ',' THEN {_cut("','")} ELSE {_cut('chr(9)')} END AS vs FROM rc JOIN dl USING (account_id)),
cell AS (SELECT account_id, row_no::INT AS row_no, CAST(i - 1 AS INT) AS col_no, CASE WHEN starts_with(vs[i], '"') THEN replace(vs[i][2:-2], '""', '"') ELSE trim(vs[i]) END AS value FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM cut)),
pick AS (SELECT account_id, kind, col_no FROM (SELECT *, {_norm('value')} AS name FROM cell WHERE row_no = 0), (VALUES {_KIND_ROWS}) v(kind, al)
  WHERE list_contains(al, name) OR (length(name) >= 3 AND len(list_filter(al, lambda a: contains(name, a) OR contains(a, name))) > 0)
  QUALIFY row_number() OVER (PARTITION BY account_id, kind ORDER BY (NOT list_contains(al, name))::INT, col_no) = 1),
stats AS (SELECT account_id, col_no, count(*) FILTER (regexp_matches(value, '{layout.DATE_CELL}')) AS date, count(*) FILTER (regexp_matches(value, '[0-9]') AND {_NUMBER} IS NOT NULL) AS amount, avg(length(value)) AS description
  FROM cell WHERE row_no BETWEEN 1 AND 50 AND value <> '' GROUP BY ALL),
{_best('date', 0)} {_best('amount', 1)} {_best('description', 2)}
gp AS (FROM pick UNION ALL FROM g0 UNION ALL FROM g1 UNION ALL FROM g2),
pr AS (SELECT account_id, row_no, CAST(try_strptime(d, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y']) AS DATE) AS date, a AS amount, x AS description FROM (
  SELECT account_id, row_no, max(value) FILTER (kind = 'date') AS d, max({_NUMBER}) FILTER (kind = 'amount') AS a, trim(max(value) FILTER (kind = 'description'), ' ' || chr(9)) AS x
  FROM cell JOIN gp USING (account_id, col_no) WHERE row_no > 0 GROUP BY ALL) WHERE d <> '' AND a <> 0 AND x <> '' AND try_strptime(d, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y']) IS NOT NULL),
dump AS (SELECT account_id, row_no AS line_no, string_agg(value, ',' ORDER BY col_no) AS text FROM cell WHERE row_no > 0 AND account_id NOT IN (SELECT account_id FROM cell WHERE row_no = 0 AND col_no > 0) GROUP BY ALL),
"""


def _cd(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^[0-9]{{4,8}}\\b\\s*', ''), ' -–−.,' || chr(160))"


_TEXT = BANK_SQL + f""", nb AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, row_no) AS n, {_cd('description')} AS cd,
  CASE WHEN row_no % 23 = 3 THEN '+' ELSE '−' END AS sg FROM bank),
tl AS (SELECT account_id, CAST(n * 3 + p AS INT) AS line_no, p, account_id % 2 = 1 AS one, description, cd, sg, abs(amount) AS a, date FROM nb, (VALUES (0), (1), (2)) v(p) WHERE account_id % 2 = 0 OR p = 0),
mn AS (SELECT *, sg || replace(printf('%.2f', a), '.', ',') || ' ₽' AS money FROM tl),
foot AS (SELECT DISTINCT account_id, 100000000 AS line_no FROM bank),
"""
_LAST = f"tx AS (SELECT account_id, n AS row_no, date, abs(amount) AS amount, left({oracles.cleaned('cd')}, 120) AS description, '' AS category, '' AS mcc FROM nb WHERE sg = '−' AND cd <> '')"
_DUMPED = f"""d0 AS (SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY date, row_no) AS row_no, date, abs(amount) AS amount, {_cd('description')} AS cd FROM bank WHERE account_id % 5 = 4),
dt AS (SELECT account_id, row_no, date, amount, left({oracles.cleaned('cd')}, 120) AS description FROM d0 WHERE cd <> '')"""
_ROLE = " ".join(f"WHEN regexp_matches(value, '(?i){p}') THEN '{r}'" for r, p in layout.ROLES)


def _filled(body: str, head: str, tail: str) -> str:
    some = f"CASE WHEN amount <> 0 THEN {_q(head)} || replace(format('{{:,.2f}}', amount), ',', ' ') || {_q(tail)} ELSE '' END"
    return f"replace(replace(replace(replace({_q(body)}, '{{amount}}', {some}), '{{last}}', '{AS_OF}'), '{{today}}', strftime(DATE '{AS_OF}', '%d.%m.%Y')), '{{name}}', name)"


_SPENT = f"""mm AS (SELECT DISTINCT account_id, unnest(merchants) AS description FROM subs),
own AS (SELECT account_id, start, round(coalesce(s, 0), 2) AS spent FROM (SELECT DISTINCT account_id FROM subs) CROSS JOIN ({oracles._MONTHS}) LEFT JOIN
  (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS start, sum(abs(amount)) AS s FROM bank JOIN mm USING (account_id, description) GROUP BY ALL) USING (account_id, start)),
every AS (SELECT account_id, start, round(coalesce(s, 0), 2) AS spent FROM (SELECT DISTINCT account_id FROM bank) CROSS JOIN ({oracles._MONTHS}) LEFT JOIN
  (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS start, sum(amount) AS s FROM bank GROUP BY ALL) USING (account_id, start))"""
ORACLES = {
    "csv_lines": _FILES + "z AS (SELECT 1) SELECT * FROM cl",
    "find_header_line": _FILES + "z AS (SELECT 1) SELECT * FROM hd",
    "detect_delimiter": _FILES + "z AS (SELECT 1) SELECT * FROM dl",
    "pick_columns": _FILES + "z AS (SELECT 1) SELECT * FROM pick",
    "guess_columns": _FILES + "z AS (SELECT 1) SELECT * FROM gp",
    "parse_rows": _FILES + "z AS (SELECT 1) SELECT * FROM pr",
    "single_column_dump": _FILES + "z AS (SELECT 1) SELECT * FROM dump",
    "dump_transactions": BANK_SQL + ", " + _DUMPED + " SELECT * FROM dt WHERE description <> ''",
    "union_sources": _FILES + _DUMPED + " SELECT account_id, date, amount, description FROM pr UNION ALL SELECT account_id, date, amount, description FROM dt WHERE description <> ''",
    "column_role": _FILES + f"z AS (SELECT 1) SELECT account_id, col_no, value, CASE {_ROLE} END AS role FROM cell WHERE row_no = 0",
    "text_lines": _TEXT + """z AS (SELECT 1) SELECT account_id, line_no, CASE WHEN one THEN strftime(date, '%d.%m.%Y') || '  ' || description || '  ' || money WHEN p = 0 THEN strftime(date, '%d.%m.%y') || ' 17:04' WHEN p = 1 THEN money ELSE description END AS text FROM mn
      UNION ALL SELECT account_id, line_no, 'Остаток на конец периода 10 000,00 ₽' FROM foot""",
    "mask_non_money": _TEXT + """z AS (SELECT *, replace(description, '866-579-7172', repeat(' ', 12)) AS m FROM mn) SELECT account_id, line_no, CASE WHEN one THEN repeat(' ', 12) || m || '  ' || money WHEN p = 0 THEN repeat(' ', 14) WHEN p = 1 THEN money ELSE m END AS masked FROM z
      UNION ALL SELECT account_id, line_no, 'Остаток на конец периода 10 000,00 ₽' FROM foot""",
    "money_scan": _TEXT + "z AS (SELECT 1) SELECT account_id, line_no, (one OR p = 1)::INT AS n, CASE WHEN one OR p = 1 THEN sg END AS sign, CASE WHEN one OR p = 1 THEN a END AS value FROM mn UNION ALL SELECT account_id, line_no, 1, '', 10000.0::DOUBLE FROM foot",
    "pick_amount": _TEXT + "z AS (SELECT 1) SELECT account_id, line_no, CASE WHEN one OR p = 1 THEN a END AS amount FROM mn UNION ALL SELECT account_id, line_no, 10000.0::DOUBLE FROM foot",
    "line_text": _TEXT + "z AS (SELECT 1) SELECT account_id, line_no, CASE WHEN one OR p = 2 THEN cd ELSE '' END AS rest FROM mn UNION ALL SELECT account_id, line_no, 'Остаток на конец периода' FROM foot",
    "clean_desc": BANK_SQL + f"SELECT DISTINCT description, {_cd('description')} AS cleaned FROM bank",
    "assemble_lines": _TEXT + "z AS (SELECT 1) SELECT account_id, n AS record, date, abs(amount) AS amount, sg AS sign, CAST(NULL AS DOUBLE) AS balance, CASE WHEN account_id % 2 = 1 THEN cd ELSE '' END AS category, CASE WHEN account_id % 2 = 1 THEN '' ELSE cd END AS words FROM nb",
    "direction_lines": _TEXT + _LAST + " SELECT * FROM tx WHERE description <> ''",
    "cell_number": BANK_SQL + """SELECT account_id, row_no, CASE row_no % 4 WHEN 0 THEN n WHEN 1 THEN replace(n, '.', ',') || ' ₽' WHEN 2 THEN '−1.234.567,' || right(n, 2) || 'руб.' ELSE 'x' || n END AS cell,
      CASE row_no % 4 WHEN 0 THEN n::DOUBLE WHEN 1 THEN n::DOUBLE WHEN 2 THEN -('1234567.' || right(n, 2))::DOUBLE END AS number FROM (SELECT *, printf('%.2f', abs(amount)) AS n FROM bank)""",
    "similar_merchants": BANK_SQL + f""", md AS (SELECT upper(translate(md5(c_custkey::VARCHAR), '0123456789', 'GHIJKLMNOP')) AS m FROM customer),
      nm AS (SELECT DISTINCT {oracles.normalized('description')} AS name FROM bank UNION SELECT m[:16] FROM md UNION SELECT m[:14] FROM md), bg AS (SELECT name, {oracles.bigrams('name')} AS g FROM nm)
      SELECT x.name AS a, y.name AS b, 2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) AS likeness FROM bg x JOIN bg y ON x.name < y.name
      WHERE len(x.g) > 0 AND len(y.g) > 0 AND 2 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) >= 0.8::DOUBLE""",
    "letter": BANK_SQL + f"""SELECT description, CASE WHEN lower(trim(name)) IN ({', '.join(map(_q, letters.FOREIGN))}) THEN {_filled(letters.ENGLISH, ' (currently ', ' RUB per month)')} ELSE {_filled(letters.RUSSIAN, ' в размере ', ' руб./мес')} END AS letter
      FROM (SELECT description, CASE WHEN contains(description, 'FIGMA') THEN ' Figma ' ELSE description END AS name, max(abs(amount)) FILTER (row_no % 3 = 0) AS amount FROM bank GROUP BY description)""",
    "latest_state": BANK_SQL + """SELECT * FROM (SELECT account_id, CAST(date AS TIMESTAMP) AS analyzed_at, CASE WHEN row_no % 7 <> 3 THEN description END AS payload FROM bank
      QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY date DESC, payload DESC NULLS FIRST) = 1) WHERE payload IS NOT NULL""",
    "monthly_all": oracles.CHAIN + _SPENT.replace("mm AS", ", mm AS", 1) + " SELECT account_id, strftime(start, '%m.%Y') AS month, spent FROM every",
    "days_left": oracles.CHAIN + f"SELECT account_id, rank, name, CAST(next_charge - DATE '{AS_OF}' AS INT) AS days_left, next_charge - DATE '{AS_OF}' <= 3 AS urgent FROM subs",
    "flat_series": oracles.CHAIN + ", " + _SPENT + " SELECT account_id, max(spent) = min(spent) AS flat FROM own GROUP BY account_id",
    "savings": oracles.CHAIN + """SELECT account_id, round(sum(monthly_cost), 2) AS monthly, round(sum(monthly_cost) * 12, 2) AS yearly, round(sum(monthly_cost) * 60, 2) AS five_years
      FROM subs WHERE (account_id, id) IN (SELECT account_id, id FROM subs WHERE rank % 2 = 0) GROUP BY account_id""",
    "report": oracles.CHAIN + ", " + _SPENT + """, sm AS (FROM own UNION ALL FROM every WHERE account_id NOT IN (SELECT account_id FROM subs)),
      ms AS (SELECT account_id, string_agg(strftime(start, '%m.%Y') || '=' || printf('%.2f', spent), '|' ORDER BY start) AS monthly FROM sm GROUP BY account_id),
      ss AS (SELECT account_id, string_agg(name, '|' ORDER BY rank) AS subscriptions, count(*) AS c, round(sum(monthly_cost), 2) AS total_monthly, round(sum(yearly_cost), 2) AS total_yearly FROM subs GROUP BY account_id)
      SELECT account_id, coalesce(subscriptions, '') AS subscriptions, monthly, coalesce(total_monthly, 0) AS total_monthly, coalesce(total_yearly, 0) AS total_yearly,
      CASE WHEN c > 0 THEN 'Выписка: ' || n || ' транзакций, найдено подписок: ' || c ELSE 'В выписке (' || n || ' транзакций) не найдено регулярных списаний — показаны общие расходы по выписке' END AS message
      FROM (SELECT account_id, count(*) AS n FROM bank GROUP BY account_id) LEFT JOIN ms USING (account_id) LEFT JOIN ss USING (account_id)""",
    "read_statements": _FILES + "z AS (SELECT 1) SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY line_no) - 1 AS INT) AS line_no, text FROM cl",
    "unreadable": BANK_SQL + """SELECT DISTINCT account_id, CASE WHEN account_id % 7 = 0 THEN 'empty' WHEN account_id % 2 = 0 THEN 'no amount' ELSE 'no date, amount' END AS reason
      FROM bank WHERE account_id % 5 <> 4 AND (account_id % 7 = 0 OR account_id % 11 = 0)""",
}
ORACLES["report_json"] = ORACLES["report"]
