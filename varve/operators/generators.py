"""Labelled columns made from seeds: names in several styles, and values by small grammars.

All is a function of md5 of (code, variant, row): the table is the same on
every run and is made where it is used, as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words that values are put together from
STREETS = ("Main", "Oak", "Mill", "Park", "Lake", "Hill", "Church", "Station")
CITIES = ("Springfield", "Riverton", "Lakeside", "Fairview", "Georgetown", "Clinton", "Salem", "Madison")
#: Other words for a kind of column, in names.
SYNONYMS = {
    "card": ("card number", "pan", "payment card"), "iban": ("iban", "bank account", "account iban"), "date": ("date", "day", "booked on"), "email": ("email", "mail address", "contact"),
    "phone": ("phone", "telephone", "mobile"), "address": ("address", "street address", "location"), "ipv4": ("ip", "host address", "client ip"), "uuid": ("uuid", "guid", "request key"),
    "url": ("url", "link", "homepage"), "ssn": ("ssn", "social security number", "tax number"), "amount": ("amount", "total", "price"), "mac": ("mac", "hardware address", "nic"),
}
# --- end of fixed values
KINDS = tuple(SYNONYMS)


def _n(h: Column, i: int, width: int = 4) -> Column:
    """A number from `width` hex digits of a hash, from digit i on."""
    return F.conv(F.substring(h, i + 1, width), 16, 10).cast("long")


def _pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits: every second one from the right is doubled."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: str, account: Column) -> Column:
    """The two check digits: 98 less the remainder of the account, the country as numbers and 00, by 97."""
    letters = "".join(str(ord(c) - 55) for c in country)
    whole = F.concat(account, F.lit(f"{letters}00")).cast("decimal(38,0)")
    return F.lpad((F.lit(98) - whole % 97).cast("int").cast("string"), 2, "0")


def value(kind: Column, h: Column) -> Column:
    """A value of one of KINDS from a hash in hex."""
    digits = lambda i, width, n: F.lpad((_n(h, i, width) % 10**n).cast("string"), n, "0")
    body = F.concat(F.lit("4"), digits(0, 7, 7), digits(7, 7, 7))
    account = F.concat(digits(0, 8, 9), digits(8, 8, 9))
    made = {
        "card": F.concat(body, luhn_digit(body)),
        "iban": F.concat(F.lit("DE"), iban_check("DE", account), account),
        "date": F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (_n(h, 0) % 27_000).cast("int")), "yyyy-MM-dd"),
        "email": F.concat(F.substring(h, 1, 8), F.lit("@example.org")),
        "phone": F.concat(F.lit("+49 "), digits(0, 4, 3), F.lit(" "), digits(4, 7, 7)),
        "address": F.concat((_n(h, 0) % 999 + 1).cast("string"), F.lit(" "), _pick(STREETS, _n(h, 4)), F.lit(" Street, "), _pick(CITIES, _n(h, 8)), F.lit(" "), digits(12, 5, 5)),
        "ipv4": F.concat_ws(".", *((_n(h, i, 2) % 256).cast("string") for i in (0, 2, 4, 6))),
        "uuid": F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "url": F.concat(F.lit("https://example.org/"), F.substring(h, 1, 10)),
        "ssn": F.concat_ws("-", digits(0, 4, 3), digits(4, 4, 2), digits(8, 4, 4)),
        "amount": F.format_string("%d.%02d", _n(h, 0) % 9_000, _n(h, 4) % 100),
        "mac": F.concat_ws(":", *(F.substring(h, i, 2) for i in (1, 3, 5, 7, 9, 11))),
    }
    out = F.lit(None).cast("string")
    for name, made_value in made.items():
        out = F.when(kind == name, made_value).otherwise(out)
    return out


def labelled_columns(categories: DataFrame, variants: int, rows: int) -> DataFrame:
    """(code, kind, column_name, opaque, row, value) for categories (code, kind).

    Every second name says nothing; the others are synonyms of the kind in
    snake, camel-less upper and prefixed style. Names end with the variant, so
    a category has each name once.
    """
    names = F.array(*(F.array(*map(F.lit, words)) for words in SYNONYMS.values()))
    seed = F.md5(F.concat_ws("/", "code", "variant"))
    base = categories.select("code", "kind", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant")).withColumn("seed", seed)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    word = F.replace(F.element_at(F.element_at(names, place), (_n(F.col("seed"), 0) % 3 + 1).cast("int")), F.lit(" "), F.lit("_"))
    style = F.col("variant") % 6
    plain = F.when(style == 0, word).when(style == 2, F.upper(word)).otherwise(F.concat(F.lit("src_"), word))
    opaque = F.col("variant") % 2 == 1
    name = F.when(opaque, F.concat(F.lit("c"), F.substring("seed", 1, 6))).otherwise(F.concat(plain, F.lit("_"), F.col("variant")))
    wide = base.withColumn("opaque", opaque).withColumn("column_name", name).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return wide.select("code", "kind", "column_name", "opaque", "row", value(F.col("kind"), F.md5(F.concat_ws("/", "seed", "row"))).alias("value"))
