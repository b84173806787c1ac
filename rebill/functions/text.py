"""Merchant names and statement cells as column expressions (no UDFs).

Null descriptions count as empty ones; cells that are no date or number give null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rebill.functions import dims

ANY_CASE = "(?iUd)"  # Unicode case folding and classes; only a line feed ends a line


def _col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _cut(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, ANY_CASE + pattern, by)


def let(value: Column, of) -> Column:
    """``of`` the value, which is computed once: the optimiser copies no more than a reference into the result."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(_col(c), "(?U)^\\s+|\\s+$", "")


def translit(c: Column | str) -> Column:
    out = F.translate(F.upper(_col(c)), *dims.ONE_TO_ONE)
    for letter, latin in dims.ONE_TO_MANY.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def squeezed(c: Column | str) -> Column:
    """Latin letters and digits only."""
    return F.regexp_replace(translit(c), "[^A-Z0-9]", "")


def squeezed_word(word: str) -> str:
    """The same of a plain string, for literals."""
    latin = word.upper().translate(str.maketrans(*dims.ONE_TO_ONE) | str.maketrans(dims.ONE_TO_MANY))
    return re.sub("[^A-Z0-9]", "", latin)


def normalize_description(c: Column | str) -> Column:
    """Latin words of two letters or more, without addresses, words with digits and stop words."""
    s = translit(c)
    for pattern in ("HTTPS?://\\S+|WWW\\.\\S+", "\\S*\\d\\S*", "[^A-Z ]+"):
        s = F.regexp_replace(s, "(?U)" + pattern, " ")
    words = F.filter(F.split(s, " "), lambda w: (F.length(w) > 1) & ~w.isin(*dims.STOP_WORDS))

    def full(w: Column) -> Column:
        out = w
        for short, name in dims.ABBREVIATIONS.items():
            out = F.when(w == short, name).otherwise(out)
        return out

    return F.array_join(F.transform(words, full), " ")


def canonical_brand(c: Column | str) -> Column:
    """struct(name, category, icon) of the first brand named in the text; null if there is none."""
    def first(up: Column) -> Column:
        hits = []
        for name, category, icon, keys in dims.BRANDS:
            found = up.rlike("|".join(map(re.escape, keys)))
            hits.append(F.when(found, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(icon).alias("icon"))))
        return F.coalesce(*hits)

    return let(F.upper(_col(c)), first)


def clean_merchant(c: Column | str) -> Column:
    """struct(name, mcc): the merchant without payment words, codes, phones, cities and bank details."""
    s = strip(_cut(_col(c), dims.BANK_TAIL))
    s = _cut(s, dims.PAY_VERB)

    def name(t: Column) -> Column:
        t = F.when(t.rlike("^[A-Za-z]{0,4}\\d[A-Za-z0-9]{0,4}\\s") & t.rlike("^[A-Za-z0-9]{2,5}\\s"), _cut(t, dims.TERMINAL_HEAD)).otherwise(t)
        return F.btrim(_cut(_cut(t, dims.NUMBER_TAIL), "\\s+", " "), F.lit(dims.EDGES))

    def parts(t: Column) -> Column:
        code = F.when(t.contains("*"), F.regexp_extract(t, ANY_CASE + dims.STAR_CODE, 2)).otherwise("")
        bare = F.when(t.contains("*"), _cut(_cut(t, dims.STAR_CODE, "$1 $3"), dims.WALLET)).otherwise(t)
        return F.struct(let(_cut(_cut(_cut(bare, dims.PHONE, " "), dims.CITY_TAIL), dims.TERMINAL_TAIL), name).alias("name"), code.alias("mcc"))

    return let(s, parts)


def group_key(c: Column | str) -> Column:
    """struct(kind, key): the brand, else the normalised name, else the raw text."""
    def key(t: Column) -> Column:
        own = F.when(t["norm"] != "", t["norm"]).otherwise(F.concat(F.lit("raw:"), F.lower(strip(t["text"]))))
        return F.struct(F.when(t["brand"].isNotNull(), "brand").otherwise("norm").alias("kind"), F.coalesce(t["brand"], own).alias("key"))

    return let(F.struct(canonical_brand(c)["name"].alias("brand"), normalize_description(c).alias("norm"), _col(c).alias("text")), key)


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring letters of the squeezed name."""
    s = squeezed(c)
    return F.when(F.length(s) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2))))).otherwise(
        F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Likeness of two sets of bigrams; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) * 2 / (F.size(a) + F.size(b)))


def parse_date(c: Column | str) -> Column:
    """Year-month-day, day.month.year, day/month/year, or a two-digit year (69 and above: the last century)."""
    def day(s: Column) -> Column:
        short = F.when(s.rlike("^\\d{1,2}\\.\\d{1,2}\\.\\d{2}$"), F.try_to_date(s, "d.M.yy"))
        short = let(short, lambda x: F.when(F.year(x) >= 2069, F.add_months(x, -1200)).otherwise(x))
        whole = lambda pattern, form: F.when(s.rlike(pattern), F.try_to_date(s, form))
        return F.coalesce(
            whole("^\\d{4}-\\d{1,2}-\\d{1,2}$", "y-M-d"), whole("^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$", "d.M.y"), whole("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/y"), short)

    return let(_col(c), lambda s: F.when(s != "", day(s)))


def parse_amount(c: Column | str) -> Column:
    return let(F.replace(F.regexp_replace(_col(c), "[^\\d.,-]", ""), F.lit(","), F.lit(".")), lambda s: F.when(s.rlike("\\d"), s.try_cast("double")))


def norm_header(c: Column | str) -> Column:
    s = F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("ё"), F.lit("е")), "\\(.*?\\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?U)[^\\wа-я ]", " "), "(?U)\\s+", " "))


def slug(c: Column | str) -> Column:
    s = F.left(F.regexp_replace(F.lower(_col(c)), "(?U)\\W+", "_"), F.lit(40))
    return F.when(s == "", "sub").otherwise(s)
