"""DuckDB text of the statement queries: one chain of common table expressions, each query reads one of them."""

from __future__ import annotations

from rebill.functions import dims
from rebill.sources.statements import AS_OF, BANK_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_case(pattern: str) -> str:
    return _q(pattern.replace("втб\\b", "втб([^\\p{L}\\p{N}_]|$)"))


def translit(x: str) -> str:
    x = f"translate(upper({x}), {_q(dims.ONE_TO_ONE[0])}, {_q(dims.ONE_TO_ONE[1])})"
    for a, b in dims.ONE_TO_MANY.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def squeezed(x: str) -> str:
    return f"regexp_replace({translit(x)}, '[^A-Z0-9]', '', 'g')"


def normalized(x: str) -> str:
    x = translit(x)
    for p in ("HTTPS?://\\S+|WWW\\.\\S+", "\\S*\\d\\S*", "[^A-Z ]+"):
        x = f"regexp_replace({x}, {_q(p)}, ' ', 'g')"
    stop = ", ".join(map(_q, dims.STOP_WORDS))
    full = "CASE w " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in dims.ABBREVIATIONS.items()) + " ELSE w END"
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop})), lambda w: {full}), ' ')"


def brand(x: str, field: int) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(upper({x}), {_q(k)})' for k in b[3])} THEN {_q(b[field])}" for b in dims.BRANDS)
    return f"CASE {cases} END"


def cleaned(x: str) -> str:
    cut = lambda e, p, by="": f"regexp_replace({e}, {_q(p)}, {_q(by)}, 'gi')"
    s = cut(cut(f"trim({cut(x, dims.BANK_TAIL)})", dims.PAY_VERB), dims.STAR_CODE, "\\1 \\3")
    s = cut(cut(s, dims.WALLET), dims.PHONE, " ")
    s = cut(cut(s, dims.CITY_TAIL), dims.TERMINAL_TAIL)
    return f"(SELECT trim({cut(cut('CASE WHEN regexp_matches(h, ' + _q('^[A-Za-z]{0,4}[0-9][A-Za-z0-9]{0,4} ') + ') AND regexp_matches(h, ' + _q('^[A-Za-z0-9]{2,5} ') + ') THEN ' + cut('h', dims.TERMINAL_HEAD) + ' ELSE h END', dims.NUMBER_TAIL), '[ ]+', ' ')}, {_q(dims.EDGES)}) FROM (SELECT {s} AS h))"


def bigrams(x: str) -> str:
    return f"(SELECT list_distinct(list_transform(range(1, length(z)), lambda i: z[i:i + 1])) FROM (SELECT {squeezed(x)} AS z))"


_DICE = "CASE WHEN len(a.pairs) = 0 OR len(y[1].pairs) = 0 THEN 0 ELSE 2 * len(list_intersect(a.pairs, y[1].pairs)) / (len(a.pairs) + len(y[1].pairs)) END >= 0.8::DOUBLE"
_GLUE = "CASE " + " ".join(
    f"WHEN length({squeezed(_q(b[0]))}) >= 4 AND (contains(z, {squeezed(_q(b[0]))}) OR (length(z) >= 4 AND contains({squeezed(_q(b[0]))}, z))) THEN {_q(b[0])}" for b in dims.BRANDS) + " END"
_BANDS = ", ".join(f"({_q(n)}, {lo}, {hi}, {k})" for _, n, lo, hi, k in dims.PERIODS)
_SAME = "({a} + {b} > 0 AND abs({a} - {b}) / (({a} + {b}) / 2) <= 0.05::DOUBLE)"


def _level(prices: str) -> str:
    same = _SAME.format(a="y[1]", b="list_aggregate(acc, 'median')")
    return f"list_filter(list_reduce(list_transform({prices}, lambda p: [p]), lambda acc, y: CASE WHEN acc[-1] < 0 THEN acc WHEN {same} THEN list_append(acc, y[1]) ELSE list_append(acc, -1.0::DOUBLE) END), lambda v: v >= 0)"


_G = "account_id, kind, key"
CHAIN = BANK_SQL + f""",
v0 AS (SELECT account_id, description, arg_min(date, date * 1) AS d0 FROM (SELECT account_id, description, epoch(date) * 100000000 + row_no AS date FROM bank WHERE abs(amount) >= 1) GROUP BY ALL),
v AS (SELECT account_id, description, d0, CASE WHEN b IS NULL THEN 'norm' ELSE 'brand' END AS kind, coalesce(b, nullif(n, ''), 'raw:' || lower(trim(description))) AS key
 FROM (SELECT *, {brand('description', 0)} AS b, {normalized('description')} AS n FROM v0)),
nk AS (SELECT account_id, key, min(d0) AS d0 FROM v WHERE kind = 'norm' GROUP BY ALL),
np AS (SELECT account_id, d0, key, {bigrams('key')} AS pairs FROM nk),
walk AS (SELECT account_id, list_reduce(list([{{'key': key, 'pairs': pairs, 'leader': key}}] ORDER BY d0, key),
  lambda acc, y: list_append(acc, {{'key': y[1].key, 'pairs': y[1].pairs, 'leader': coalesce(list_filter(acc, lambda a: a.key = a.leader AND {_DICE})[1].leader, y[1].key)}})) AS ys FROM np GROUP BY account_id),
led AS (SELECT account_id, y.key AS key, y.leader AS leader, CAST(list_position(lst, y.leader) AS INT) AS place
  FROM (SELECT account_id, list_transform(list_filter(ys, lambda a: a.key = a.leader), lambda a: a.key) AS lst, unnest(ys) AS y FROM walk)),
glued AS (SELECT account_id, key, leader, place, {_GLUE} AS brand FROM (SELECT *, {squeezed('leader')} AS z FROM led)),
keys AS (SELECT v.account_id, v.description, CASE WHEN brand IS NULL THEN v.kind ELSE 'brand' END AS kind, coalesce(brand, leader, v.key) AS key, CASE WHEN brand IS NULL THEN 0 ELSE place END AS glue
  FROM v LEFT JOIN glued g ON v.account_id = g.account_id AND v.key = g.key AND v.kind = 'norm'),
it AS (SELECT b.*, kind, key, glue FROM bank b JOIN keys USING (account_id, description) WHERE abs(amount) >= 1),
smp AS (SELECT {_G}, key || ' ' || string_agg(description, ' ' ORDER BY n) AS sample FROM (
  SELECT {_G}, description, row_number() OVER (PARTITION BY {_G} ORDER BY min(glue), min(epoch(date) * 100000000 + row_no)) AS n FROM it GROUP BY {_G}, description) WHERE n <= 4 GROUP BY {_G}),
ver AS (SELECT {_G}, n, CASE WHEN regexp_matches(sample, {_any_case(dims.INTERNAL)}, 'i') THEN 'internal' WHEN regexp_matches(sample, {_any_case(dims.UTILITY)}, 'i') THEN 'utility'
  WHEN regexp_matches(sample, {_any_case(dims.RETAIL)}, 'i') THEN 'retail' WHEN regexp_matches(trim(key), {_any_case(dims.CITY_ONLY)}, 'i') THEN 'city'
  WHEN c > 0 AND c >= n * 0.6 THEN 'category' WHEN m > 0 AND m >= n * 0.6 THEN 'code' WHEN n < CASE kind WHEN 'brand' THEN 2 ELSE 3 END THEN 'few' END AS rejected
  FROM (SELECT {_G}, count(*) AS n, count_if(coalesce(regexp_matches(category, {_any_case(dims.CATEGORIES)}, 'i'), false)) AS c,
   count_if(coalesce(mcc IN ({', '.join(map(_q, dims.CODES))}), false)) AS m FROM it GROUP BY {_G}) JOIN smp USING ({_G})),
ok AS (SELECT it.* FROM it JOIN ver USING ({_G}) WHERE rejected IS NULL),
cl AS (SELECT {_G}, list_reduce(list([{{'a': amount, 'c': 1}}] ORDER BY amount), lambda acc, y: list_append(acc, {{'a': y[1].a, 'c': CASE WHEN
   abs(y[1].a - list_filter(acc, lambda e: e.c = acc[-1].c)[len(list_filter(acc, lambda e: e.c = acc[-1].c)) // 2 + 1].a)
   <= 0.12::DOUBLE * abs(list_filter(acc, lambda e: e.c = acc[-1].c)[len(list_filter(acc, lambda e: e.c = acc[-1].c)) // 2 + 1].a) THEN acc[-1].c ELSE acc[-1].c + 1 END}})) AS xs FROM ok GROUP BY {_G}),
pc AS (SELECT DISTINCT {_G}, x.a AS amount, CAST(x.c AS INT) AS cluster FROM (SELECT {_G}, unnest(xs) AS x FROM cl)),
newest AS (SELECT {_G}, amount AS new FROM ok QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY date DESC, glue, row_no) = 1),
cs AS (SELECT {_G}, cluster, count(*) AS cn, bool_or(amount = new) AS cnew, min(date) AS lo, max(date) AS hi, list_sort(list(abs(amount))) AS ps
  FROM ok JOIN pc USING ({_G}, amount) JOIN newest USING ({_G}) GROUP BY {_G}, cluster),
mn AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY cn DESC, cnew DESC, cluster) = 1),
pr AS (SELECT {_G}, ps[len(ps) // 2 + 1] AS price FROM cs WHERE cnew),
st AS (SELECT ok.*, cs.cluster, cs.cluster = mn.cluster AS main, price FROM ok JOIN pc USING ({_G}, amount) JOIN cs USING ({_G}, cluster) JOIN mn USING ({_G}) JOIN pr USING ({_G})
  WHERE mn.cn >= CASE kind WHEN 'brand' THEN 2 ELSE 3 END AND (cs.cluster = mn.cluster OR cs.cnew OR (cs.cn >= 2 AND (cs.hi < mn.lo OR cs.lo > mn.hi)))),
sg AS (SELECT *, date - lag(date) OVER w AS gap, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY {_G} ORDER BY date, main DESC, cluster, amount, glue, row_no)),
ch0 AS (SELECT {_G}, list(abs(amount) ORDER BY date DESC, glue DESC, row_no DESC) AS rev, list(date ORDER BY date, glue, row_no) AS ds FROM ok GROUP BY {_G} HAVING count(*) >= 4),
ch1 AS (SELECT *, {_level('rev')} AS nw FROM ch0),
ch2 AS (SELECT *, {_level('rev[len(nw) + 1:]')} AS ol FROM ch1 WHERE len(nw) >= 2 AND len(nw) < len(rev)),
ch3 AS (SELECT {_G}, list_aggregate(ol, 'median') AS a, list_aggregate(nw, 'median') AS b, ds[len(rev) - len(nw) + 1] AS changed_at FROM ch2 WHERE len(ol) >= 2),
chg AS (SELECT {_G}, CASE WHEN difference > 0 THEN 'up' ELSE 'down' END AS direction, round(a, 2) AS old_price, round(b, 2) AS new_price, difference, round(difference / a * 100, 2) AS percent_change, changed_at
  FROM (SELECT *, round(b - a, 2) AS difference FROM ch3 WHERE NOT {_SAME.format(a='a', b='b')}) WHERE abs(round(difference / a * 100, 2)) >= 5),
roll AS (SELECT {_G}, count(*) AS charges, round(sum(abs(amount)), 2) AS total_paid, min(price) AS price, min(date) AS first_charge, max(date) AS last_charge,
  list_sort(list(DISTINCT description)) AS merchants, arg_max(description, rn) AS spelling, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM sg GROUP BY {_G}),
band AS (SELECT * FROM roll JOIN (VALUES {_BANDS}) p(period, lo, hi, months) ON gaps[len(gaps) // 2 + 1] BETWEEN lo AND hi
  WHERE charges >= CASE kind WHEN 'brand' THEN 2 ELSE 3 END AND len(list_filter(gaps, lambda g: g BETWEEN lo AND hi)) >= len(gaps) * 0.6),
RECURSION_
ttl AS (SELECT *, {brand('spelling', 0)} AS bn, {brand('spelling', 1)} AS bc, {brand('spelling', 2)} AS bi,
  CASE WHEN kind = 'brand' THEN key ELSE array_to_string(list_transform(string_split(key, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title FROM band),
subs AS (SELECT {_G}, left(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), 40) AS id, CASE WHEN kind = 'brand' THEN coalesce(bn, title) ELSE title END AS name,
  coalesce(bc, '{dims.OTHER}') AS category, coalesce(bi, '{dims.OTHER_ICON}') AS icon, round(price, 2) AS amount, period, round(price / months, 2) AS monthly_cost, round(price / months * 12, 2) AS yearly_cost,
  charges, total_paid, DATE '{AS_OF}' - last_charge <= months * 62 AS active, first_charge, last_charge, nx AS next_charge, merchants, direction, old_price, new_price, difference, percent_change, changed_at,
  row_number() OVER (PARTITION BY account_id ORDER BY round(price / months, 2) DESC, sglue, sd) AS rank
  FROM ttl JOIN nxt USING ({_G}) LEFT JOIN chg USING ({_G}) JOIN (SELECT {_G}, min(glue) AS sglue, arg_min(epoch(date) * 100000000 + row_no, glue * 1e18 + epoch(date) * 100000000 + row_no) AS sd FROM ok GROUP BY {_G}) USING ({_G})
  WHERE length(trim(coalesce(bn, title))) >= 3)
"""
_NEXT = f"""nxt0 AS (SELECT {_G}, months, CAST(last_charge + to_months(CAST(months AS INT)) AS DATE) AS nx FROM band),
steps AS (SELECT {_G}, months, nx FROM nxt0 UNION ALL SELECT {_G}, months, CAST(nx + to_months(CAST(months AS INT)) AS DATE) FROM steps WHERE nx < DATE '{AS_OF}'),
nxt AS (SELECT {_G}, max(nx) AS nx FROM steps GROUP BY {_G}),"""
CHAIN = CHAIN.replace("RECURSION_", _NEXT).replace("WITH bank AS", "WITH RECURSIVE bank AS", 1)
_MONTHS = f"SELECT CAST(date_trunc('month', DATE '{AS_OF}') - to_months(CAST(i AS INT)) AS DATE) AS start FROM (SELECT unnest(range(0, 6)) AS i)"
_OLD = "CASE WHEN old_price > 0 THEN CASE WHEN period = 'ежегодно' THEN old_price / 12 ELSE old_price END ELSE monthly_cost END"


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"


_FLAT = "* REPLACE (array_to_string(merchants, '|') AS merchants)"
ORACLES = {
    "drop_micro": BANK_SQL + "SELECT * FROM bank WHERE abs(amount) >= 1",
    "charge_gaps": CHAIN + f"SELECT {_G}, row_no, date, amount, CAST(gap AS INT) AS gap FROM sg",
    "newest_charge": CHAIN + f"SELECT {_G}, row_no, date, amount, description FROM ok QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY date DESC, glue, row_no) = 1",
    "cadence": CHAIN + f"SELECT {_G}, charges, last_charge, period, months FROM band",
    "bank_rows": BANK_SQL + "SELECT * FROM bank",
    "merchant_text": BANK_SQL + f"SELECT description, {translit('description')} AS latin, {normalized('description')} AS norm, {brand('description', 0)} AS brand, {cleaned('description')} AS cleaned FROM (SELECT DISTINCT description FROM bank)",
    "group_key": CHAIN + "SELECT account_id, description, kind, key FROM v",
    "fuzzy_leader_merge": CHAIN + "SELECT * FROM led",
    "glue_to_brand": CHAIN + "SELECT account_id, key, leader, brand FROM glued WHERE brand IS NOT NULL",
    "group_items": CHAIN + "SELECT * FROM it",
    "group_sample": CHAIN + "SELECT * FROM smp",
    "reject_groups": CHAIN + "SELECT * FROM ver",
    "price_clusters": CHAIN + f"SELECT {_G}, amount, cluster FROM pc",
    "stable_charges": CHAIN + f"SELECT {_G}, row_no, date, amount, main, cluster, price, CAST(gap AS INT) AS gap FROM sg",
    "price_change": CHAIN + "SELECT * FROM chg",
    "subscriptions": CHAIN + f"SELECT {_FLAT} FROM subs",
    "totals": CHAIN + "SELECT account_id, count(*) AS subscriptions, round(sum(monthly_cost), 2) AS total_monthly, round(sum(yearly_cost), 2) AS total_yearly FROM subs GROUP BY ALL",
    "duplicates": CHAIN + f"""SELECT account_id, category, services, names, round(m, 2) AS monthly, round(m - l, 2) AS savings, round((m - l) * 12, 2) AS yearly_savings FROM (
      SELECT account_id, category, count(*) AS services, string_agg(name, ', ' ORDER BY name) AS names, sum(monthly_cost) AS m, min(monthly_cost) AS l FROM subs WHERE category <> '{dims.OTHER}' GROUP BY ALL) WHERE services >= 2""",
    "growth": CHAIN + f"""SELECT * FROM (SELECT *, CAST(floor((now / before - 1) * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT account_id, round(sum(monthly_cost), 2) AS now, round(sum({_OLD}), 2) AS before,
      first(name ORDER BY percent_change DESC, rank) FILTER (old_price > 0) AS worst FROM subs GROUP BY account_id)) WHERE abs(percent) >= 1""",
    "monthly_from_txs": CHAIN + f""", mm AS (SELECT DISTINCT account_id, unnest(merchants) AS description FROM subs)
      SELECT account_id, strftime(start, '%m.%Y') AS month, round(coalesce(s, 0), 2) AS spent FROM (SELECT DISTINCT account_id FROM subs) CROSS JOIN ({_MONTHS}) LEFT JOIN
      (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS start, sum(abs(amount)) AS s FROM bank JOIN mm USING (account_id, description) GROUP BY ALL) USING (account_id, start)""",
    "monthly_model": CHAIN + f"""SELECT account_id, strftime(start, '%m.%Y') AS month, round(sum(CASE WHEN datediff('month', first_charge, start) BETWEEN 0 AND 239 THEN monthly_cost ELSE 0 END), 2) AS spent
      FROM subs CROSS JOIN ({_MONTHS}) GROUP BY account_id, start""",
    "upcoming": CHAIN + """SELECT account_id, strftime(next_charge, '%m.%Y') AS month, name, next_charge, amount, row_number() OVER (PARTITION BY account_id ORDER BY next_charge, amount DESC, rank) AS place,
      round(sum(amount) OVER (PARTITION BY account_id, mo), 2) AS month_total, count(*) OVER (PARTITION BY account_id, mo) AS month_count FROM (
      SELECT * FROM (SELECT *, date_trunc('month', next_charge) AS mo FROM subs WHERE active) QUALIFY dense_rank() OVER (PARTITION BY account_id ORDER BY mo) <= 2)""",
    "enrich_links": CHAIN + f"SELECT account_id, rank, name, coalesce({_case('trim(name)', dims.CANCEL)}, '{dims.SEARCH}' || replace(trim(name), ' ', '+')) AS cancel_url, {_case('name', dims.INCLUDED)} AS included_in FROM subs",
}
