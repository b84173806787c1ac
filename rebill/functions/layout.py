"""Fixed values of statement files: words and patterns that results depend on."""

# Header names by kind of column.
ALIASES = {
    "date": ("date", "дата", "дата операции", "дата платежа", "operation date", "transaction date"),
    "amount": ("amount", "сумма", "сумма платежа", "сумма операции", "списание", "value"),
    "description": ("description", "описание", "наименование", "получатель", "merchant", "назначение", "details", "memo"),
    "category": ("category", "категория", "тип"),
}
DELIMITERS = (";", "\t", ",")
HEADER_LINES, SAMPLE_ROWS, SNIFFED = 15, 50, 4096
DATE_CELL = "\\d{1,4}[./-]\\d{1,2}[./-]\\d{2,4}"
# Roles of columns by header, the first that fits.
ROLES = (
    ("date", "дата|дат[аы]\\s*,?\\s*врем"), ("balance", "остаток|баланс|входящ|исходящ"), ("debit", "дебет|расход|списан|уменьшен|снят"),
    ("credit", "кредит|приход|поступлен|зачислен|увеличен|пополнен"), ("amount", "сумма|amount"), ("category", "категор"),
    ("description", "назначен|описан|получател|детал|коммент|контрагент|мерчант"), ("account", "^сч[ёе]т"))
# Lines that describe no operation, dates and times in lines.
SKIP = (
    "продолжение|страниц|сформирова|справк|выписк|сч[ёе]т\\b|доступн|баланс|всего|итого|период|владелец|статус|реквизит|валюта|назначение|"
    "остаток|номер сч|дата откр|дата закрыт|действителен|расшифровк|дата операции|описание операц|категория|сумма в валюте")
LINE_DATE = "\\b(\\d{2}[./]\\d{2}[./]\\d{2,4})\\b"
TIME_ONLY = "^[\\d\\s:.,+−–—-]+$"
CARD_TAIL = "\\s*Операция по карте(?:\\s*\\*{2,}[\\dx]+)?\\s*$"
DAY, TIME = "\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}", "\\d{1,2}:\\d{2}(?::\\d{2})?"
BLANKS = " \u00a0\u202f"
MINUS = "-−–—"
# What looks like a number in a line but is no money.
NOT_MONEY = (DAY, TIME, "\\*{2,}\\s?\\d{2,6}", "\\+?\\d[\\d()-]{9,}\\d", "\\d{10,}")
MONEY = f"([+\\-−–—])?[{BLANKS}]?(\\d{{1,3}}(?:[{BLANKS}]\\d{{3}})+|\\d{{1,9}})(?:([.,])(\\d{{1,2}}))?(?:[{BLANKS}]{{0,2}}(₽|руб\\.|руб|rub|р\\.))?"
MOST_MONEY = 100_000_000
