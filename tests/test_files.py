import csv
import io
import json
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st

from rebill.operators import ingest, lines, report, state
from rebill.sources.files import read_statements


def parsed(spark, folder, contents):
    """Rows and missing columns of each of the files, read together."""
    for i, content in enumerate(contents):
        (folder / f"{i}.csv").write_bytes(content)
    x = read_statements(spark, str(folder)).cache()
    head = ingest.find_header_line(x)
    cell = ingest.statement_cells(x, head, ingest.detect_delimiter(x, head)).cache()
    pick = ingest.guess_columns(cell, ingest.pick_columns(cell)).cache()
    number = {r["account_id"]: int(r["path"].rsplit("/", 1)[1][:-4]) for r in x.select("account_id", "path").distinct().collect()}
    out = [([], 0) for _ in contents]
    for r in ingest.parse_rows(cell, pick).orderBy("row_no").collect():
        out[number[r.account_id]][0].append((r.date, r.amount, r.description))
    for r in ingest.missing_columns(head, pick).collect():
        out[number[r.account_id]] = (out[number[r.account_id]][0], 1)
    return out


def test_files(spark, tmp_path):
    cases = [
        ("Date,Description,Amount\n2026-01-05,NETFLIX,-599.00\n,NETFLIX,-599.00\n".encode("utf-8-sig"), [(date(2026, 1, 5), -599.0, "NETFLIX")], 0),
        ("Дата операции;Сумма;Описание\n05.08.2026;-599,00;Кино\n06.08.2026;0;Ноль\n".encode("cp1251"), [(date(2026, 8, 5), -599.0, "Кино")], 0),
        ("Дата и время;Сумма (руб);Назначение платежа\n05.08.2026;-1,50;a\n".encode(), [(date(2026, 8, 5), -1.5, "a")], 0),
        (b"Col1,Col2,Col3\n05.08.2026,long enough text,-7.25\n06.08.2026,long enough text,-7.25\n", [(date(2026, 8, 5), -7.25, "long enough text"), (date(2026, 8, 6), -7.25, "long enough text")], 0),
        (b"foo,bar\n,\n", [], 1),
        (b'Date,Description,Amount\n2026-01-05,"Amazon, Inc",-599.00\n2026-01-06,"A ""B"" C",-1.50\n2026-01-07,5" disk,-2.00\n',
         [(date(2026, 1, 5), -599.0, "Amazon, Inc"), (date(2026, 1, 6), -1.5, 'A "B" C'), (date(2026, 1, 7), -2.0, '5" disk')], 0),
        ('Дата;Сумма;Описание\n05.08.2026;-599,00;"Кино; зал, 2"\n06.08.2026;-10,00;Кино\n'.encode("cp1251"), [(date(2026, 8, 5), -599.0, "Кино; зал, 2"), (date(2026, 8, 6), -10.0, "Кино")], 0),
        (b'date;amount;memo\n05.08.2026;-7;"two\n\nlines; ""q"" "\n06.08.2026;-8;"x"y\n07.08.2026;-9;"open;\n08.08.2026;-9;rest\n',
         [(date(2026, 8, 5), -7.0, 'two\n\nlines; "q"'), (date(2026, 8, 6), -8.0, "xy"), (date(2026, 8, 7), -9.0, "open;\n08.08.2026;-9;rest")], 0),
    ]
    got = parsed(spark, tmp_path, [content for content, _, _ in cases])
    for i, (_, want, missing) in enumerate(cases):
        assert got[i] == (want, missing), i


TEXT = st.text(st.sampled_from(['"', ";", ",", "\n", "a", "b"]), max_size=40)


def test_records_and_cells_as_a_csv_reader(spark):
    """Any mess of quotes, delimiters and line breaks, against the library's reader."""
    texts: list[str] = []

    @settings(max_examples=600, deadline=None, database=None, derandomize=True)
    @given(TEXT)
    def collect(t):
        texts.append(t)

    collect()
    lines_ = [(i, j, x) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n"))]
    frame = spark.createDataFrame(lines_, "account_id long, line_no int, text string")
    for d in (";", ","):
        got = ingest.records(frame, d).select("account_id", "line_no", ingest.cells("text", d).alias("c")).collect()
        found = {}
        for r in sorted(got):
            found.setdefault(r["account_id"], []).append(r["c"])
        for i, t in enumerate(texts):
            want = [[c.strip(" ") for c in row] or [""] for row in csv.reader(io.StringIO(t), delimiter=d)]
            assert [x for x in found[i] if x != [""]] == [x for x in want if x != [""]], (t, d)


def test_money(spark):
    cases = {
        "-599,00 ₽": [("-", 599.0, 0, 9)], "+1 200,00 руб.": [("+", 1200.0, 0, 14)], "599.0 RUB": [("", 599.0, 0, 9)], "866-579-7172": [], "код 123456": [], None: [],
        "05.03.2026 10:04:12 −5,00 и 1\u00a0234,5": [("−", 5.0, 20, 25), ("", 1234.5, 28, 35)], "5-599,00": [("", 599.0, 2, 8)], "a/599,00": [], "1,2,30": [], "100000000,00 ₽": [],
        "**** 1234 7,00": [("", 7.0, 10, 14)], "a\ue000-1,00": [("-", 1.0, 2, 7)]}
    frame = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: [tuple(m) for m in r["found"]] for r in frame.select("text", lines.money_scan("text").alias("found")).collect()}
    assert got == cases
    masked = frame.select("text", lines.mask_non_money("text").alias("m")).where("text is not null").collect()
    assert all(len(r["m"]) == len(r["text"]) for r in masked)
    assert [m["value"] for m in frame.where("text = 'код 123456'").select(lines.money_scan("text", strict=False).alias("f")).first()["f"]] == [123456.0]


def test_printed_lines(spark):
    texts = {
        1: ["05.08.26 17:04", "−599,00 ₽", "NETFLIX.COM", "06.08.26 10:00", "+1000,00 ₽", "SALARY", "Остаток на конец 5 000,00 ₽"],
        2: ["05.08.2026  NETFLIX.COM  -599,00 ₽", "", "99.99.2026 none"],
        3: ["01.02.2026 Подписки 100,00 1 900,00", "10:04 123456 SHOP ONE", "02.02.2026 Зачисление 50,00 1 950,00"]}
    rows = [(a, i, t) for a, ts in texts.items() for i, t in enumerate(ts)]
    frame = spark.createDataFrame(rows, "account_id long, line_no int, text string")
    # A line with an impossible date goes on with the record before it.
    got = [(r.account_id, r.date, r.amount, r.description) for r in lines.direction_lines(lines.assemble_lines(frame)).orderBy("account_id", "row_no").collect()]
    assert got == [(1, date(2026, 8, 5), 599.0, "NETFLIX.COM"), (2, date(2026, 8, 5), 599.0, "none"), (3, date(2026, 2, 1), 100.0, "SHOP ONE")]


def test_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01", "a"), (1, "2026-01-02", "b"), (2, "2026-01-01", "c")], "account_id long, t string, payload string")
    new, path = rows.selectExpr("account_id", "cast(t as timestamp) as analyzed_at", "payload"), str(tmp_path / "states")
    held = lambda: sorted((r.account_id, r.payload) for r in state.load(spark, path).collect())
    state.save(new, path, 4)
    assert held() == [(1, "b"), (2, "c")]
    state.clear(spark.createDataFrame([(2,)], "account_id long"), "2026-01-03", path, 4)
    assert held() == [(1, "b")]
    files = lambda: sum(1 for _ in (tmp_path / "states").rglob("*.parquet"))
    before = files()
    for _ in range(3):
        state.save(new, path, 4)  # older than the clearing, or there already
    assert held() == [(1, "b")] and files() == before
    assert spark.read.parquet(path).count() == 2


def test_json(spark, tmp_path):
    one = spark.createDataFrame([(7, False, [("Ünï", 1.5)], 2.0)], "account_id long, mock boolean, subscriptions array<struct<name:string,amount:double>>, total_monthly double")
    whole = one.selectExpr("*", "array(named_struct('month', '01.2026', 'spent', 3.5D)) monthly", "24.0D total_yearly", "'Выписка' message")
    report.write_json(whole, str(tmp_path / "json"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(text)["subscriptions"] == [{"name": "Ünï", "amount": 1.5}] and "Выписка" in text
