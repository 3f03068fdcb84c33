"""Column profiles from cells (source_table, column_name, value), one row a cell.

All columns of all tables go through the same aggregates at once; nothing is
gathered for a column but its bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, TimestampNTZType, TimestampType

from varve.functions import names
from varve.session import written

KEY = ["source_table", "column_name"]

# --- fixed values: indicator words of data elements (name, domain, words)
ELEMENTS = (
    ("PaymentCard", "finance", ("card_number", "pan", "cvv", "expiry", "cardholder", "card_type", "payment_card", "card_brand")),
    ("PostalAddress", "contact", ("street", "city", "state", "zip", "postal_code", "country", "address_line", "zip_code", "province")),
    ("PersonName", "identity", ("first_name", "last_name", "full_name", "middle_name", "given_name", "surname", "family_name", "name_prefix")),
    ("ContactInfo", "contact", ("email", "phone", "mobile", "fax", "telephone", "phone_number", "email_address", "contact_number")),
    ("BankAccount", "finance", ("account_number", "routing_number", "iban", "swift", "bank_code", "sort_code", "bic", "account_type")),
    ("GovernmentID", "identity", ("ssn", "social_security", "tax_id", "passport", "driver_license", "national_id", "tin", "ein")),
    ("BiospecimenCollection", "healthcare", ("sample_location", "specimen_type", "collection_date", "anatomical_site", "instrument", "biopsy", "tissue", "sample_id", "specimen_id", "pathology")),
    ("PatientDemographics", "healthcare", ("date_of_birth", "gender", "sex", "ethnicity", "race", "marital_status", "blood_type", "patient_id", "mrn")),
    ("GeoLocation", "spatial", ("latitude", "longitude", "lat", "lng", "lon", "geo_location", "coordinates", "altitude", "geohash")),
    ("DeviceIdentity", "technology", ("device_id", "mac_address", "ip_address", "imei", "serial_number", "hostname", "uuid", "hardware_id")),
    ("Credential", "security", ("password", "pin", "secret", "token", "api_key", "passphrase", "auth_token", "access_key")),
)
ELEMENT_LEAST = 2
#: Descriptions of a column's values.
DESCRIPTIONS = {
    "date": "column of date values in YYYY-MM-DD format", "email": "column of email addresses", "url": "column of URLs or web links", "uuid": "column of UUID identifiers",
    "sequence": "column of sequential integers, likely identifiers or index", "decimal": "column of decimal numeric measurements", "integer": "column of integer values",
    "long": "column of long text content, descriptions or comments", "phrase": "column of text phrases or sentences", "category": "column of categorical labels or codes",
    "short": "column of short text labels or names", "text": "column of text values",
}
# --- end of fixed values


def cells(df: DataFrame, source_table: str) -> DataFrame:
    """A table as cells."""
    wide = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    return wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "value").withColumn("source_table", F.lit(source_table))


#: Longer values (in bytes) are counted by their first characters and a digest; only chosen ones are read whole.
WIDE, DIGEST = 100, 32


def sample(cells: DataFrame, n: int, how: str = "frequent", seed: str = "") -> DataFrame:
    """The n values of each column (value, n, place): first, most frequent, or random.

    One distinct pass for all columns; ties go by value, random ones by md5.
    Values beyond WIDE bytes take part in it by their first WIDE characters
    and an md5, so long texts are neither shuffled nor sorted. Every value
    whose place may be among the n (all ties of the first characters) is
    written; only columns that have wide ones among these are read again, for
    the whole values, which then decide exactly. Empty and null values don't
    count.
    """
    filled = cells.where(_filled("value"))
    counts = filled.groupBy(*KEY, _short(F.col("value"), seed).alias("key")).agg(F.count("*").alias("n"))
    # columns are few; naming them leaves out all other tables
    named = lambda wide: filled.where(reduce(Column.__or__, ((F.col("source_table") == t) & (F.col("column_name") == c) for t, c in wide)))
    return _chosen(counts, KEY, named, n, how, seed)


#: Rows of a table that bounds for its first or random values come from. A column is held to its bound if more than 1 in VARIED of these differ.
BOUND_ROWS, VARIED = 20_000, 8


def sample_tables(tables: dict[str, DataFrame], n: int, how: str = "frequent", seed: str = "") -> DataFrame:
    """The same as `sample` of all cells of the tables, but cells are counted before they are printed.

    Columns of one type are unpivoted together, and what is grouped and
    shuffled is the value in its own type and a number for its column; only
    distinct values become strings. Types whose values may be printed alike
    (floating point, nested) are printed first. Of columns with many different
    values the n-th (first or random) of some rows is a bound that the n-th of
    all can't pass, so values beyond it aren't counted (exact).
    """
    columns = [(t, c) for t, df in tables.items() for c in df.columns]
    bounds = _bounds(tables, columns, n, how, seed) if how != "frequent" else {}
    kinds: dict[str, list[DataFrame]] = {}
    for t, df in tables.items():
        typed = df.select(*(_within(_typed(df, c), bounds.get((t, c)), how, seed).alias(str(columns.index((t, c)))) for c in df.columns))
        for kind in dict.fromkeys(kind for _, kind in typed.dtypes):
            own = [f"`{c}`" for c, k in typed.dtypes if k == kind]
            kinds.setdefault(kind, []).append(typed.select(*own).unpivot([], own, "at", "key"))
    counts = []
    for kind, parts in kinds.items():
        some = reduce(DataFrame.unionByName, parts).where(_filled("key") if kind == "string" else F.col("key").isNotNull())
        key = _short(F.col("key"), seed) if kind == "string" else F.col("key")
        counts.append(some.groupBy(F.col("at").cast("int").alias("at"), key.alias("key")).agg(F.count("*").alias("n")).withColumn("key", F.col("key").cast("string")))

    def named(wide: list[tuple[str, str]]) -> DataFrame:
        of = {t: [f"`{c}`" for u, c in wide if u == t] for t, _ in wide}
        return reduce(DataFrame.unionByName, (cells(tables[t].select(*cs), t) for t, cs in of.items())).where(_filled("value"))

    name = lambda i: F.element_at(F.array(*(F.lit(key[i]) for key in columns)), F.col("at") + 1)
    return _chosen(reduce(DataFrame.unionByName, counts), ["at"], named, n, how, seed, {k: name(i) for i, k in enumerate(KEY)})


def _typed(df: DataFrame, c: str) -> Column:
    """A column in the type that its values are counted in: one in which different values are printed differently."""
    kind = df.schema[c].dataType
    if isinstance(kind, IntegralType):
        return F.col(f"`{c}`").cast("long")
    return F.col(f"`{c}`") if isinstance(kind, (DecimalType, DateType, TimestampType, TimestampNTZType)) else F.col(f"`{c}`").cast("string")


def _bounds(tables: dict[str, DataFrame], columns: list[tuple[str, str]], n: int, how: str, seed: str) -> dict[tuple[str, str], str]:
    """What the n-th value of some rows of a column is ranked by, for varied columns."""
    some = []
    for t, df in tables.items():
        short = [_short(F.col(f"`{c}`").cast("string"), seed).alias(str(columns.index((t, c)))) for c in df.columns]
        rows = df.select(*short).limit(BOUND_ROWS)
        some.append(rows.unpivot([], [f"`{c}`" for c in rows.columns], "at", "key").where(_filled("key")))
    counts = reduce(DataFrame.unionByName, some).groupBy("at", "key").agg(F.count("*").alias("n"))
    column = Window.partitionBy("at")
    ranked = counts.withColumn("by", _rank_by(F.col("key"), how, seed)).withColumn("varied", F.count("*").over(column) * VARIED > F.sum("n").over(column))
    ranked = ranked.withColumn("place", F.row_number().over(column.orderBy("by")))
    return {columns[int(r.at)]: r.by for r in ranked.where((F.col("place") == n) & F.col("varied")).select("at", "by").collect()}


def _within(value: Column, bound: str | None, how: str, seed: str) -> Column:
    """The value, or null beyond the bound."""
    return value if bound is None else F.when(_rank_by(_short(value.cast("string"), seed), how, seed) <= bound, value)


def _filled(value: str) -> Column:
    return F.col(value).isNotNull() & (F.col(value) != "")


def _draw(value: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), value))


def _short(value: Column, seed: str) -> Column:
    """The value, or of one beyond WIDE bytes its first WIDE characters and its draw."""
    return F.when(F.octet_length(value) > WIDE, F.concat(F.substring(value, 1, WIDE), _draw(value, seed))).otherwise(value)


def _rank_by(key: Column, how: str, seed: str) -> Column:
    """What short values are ranked by, the most frequent ones among ties: their first characters, or their draw."""
    wide = F.octet_length(key) > WIDE
    if how == "random":
        return F.when(wide, F.right(key, F.lit(DIGEST))).otherwise(_draw(key, seed))
    return F.when(wide, F.left(key, F.length(key) - DIGEST)).otherwise(key)


def _chosen(counts: DataFrame, by: list[str], named: Callable[[list[tuple[str, str]]], DataFrame], n: int, how: str, seed: str, names_of: dict[str, Column] | None = None) -> DataFrame:
    """The sample from the counts (by, key, n) of short values; `named` gives the filled cells of some columns."""
    order = [F.col("n").desc(), _rank_by(F.col("key"), how, seed)] if how == "frequent" else [_rank_by(F.col("key"), how, seed)]
    ranked = counts.withColumn("wide", F.octet_length("key") > WIDE).withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
    best = written(ranked.withColumns(names_of or {}).select(*KEY, "key", "n", "wide"), "sampled")
    found = best.where(~F.col("wide")).select(*KEY, F.col("key").alias("value"), "n")
    if wide := best.where("wide").select(*KEY).distinct().collect():
        whole = named([tuple(r) for r in wide]).where(F.octet_length("value") > WIDE).withColumn("key", _short(F.col("value"), seed)).join(best.where("wide"), [*KEY, "key"])
        found = found.unionByName(whole.select(*KEY, "value", "n").distinct())
    exact = {"head": [F.col("value")], "frequent": [F.col("n").desc(), F.col("value")], "random": [_draw(F.col("value"), seed)]}[how]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(*exact))).where(F.col("place") <= n)


def null_ratio(cells: DataFrame) -> DataFrame:
    empty = F.avg((F.col("value").isNull() | (F.col("value") == "")).cast("double"))
    return cells.groupBy(*KEY).agg(F.round(empty, 4).alias("null_ratio"))


def null_ratio_tables(tables: dict[str, DataFrame], decimals: dict[str, DecimalType] | None = None) -> DataFrame:
    """The same as `null_ratio` of all cells of the tables: one aggregate a table over its columns, nothing is unpivoted but the result.

    `decimals` names columns of floating point that count as decimals.
    """
    decimals = decimals or {}

    def empty(c: str, kind: str) -> Column:
        value = F.col(f"`{c}`")
        if c in decimals:  # only very large values and NaN need the conversion
            return value.isNull() | ((F.abs(value) >= 10.0 ** (decimals[c].precision - decimals[c].scale - 1)) & value.cast(decimals[c]).isNull())
        return value.isNull() | (value == "") if kind == "string" else value.isNull()

    ratios = lambda df: [F.round(F.avg(empty(c, kind).cast("double")), 4).alias(c) for c, kind in df.dtypes]
    some = lambda df: df.groupBy().agg(*ratios(df)).unpivot([], [f"`{c}`" for c in df.columns], "column_name", "null_ratio")
    found = (some(df).select(F.lit(t).alias("source_table"), "column_name", "null_ratio") for t, df in tables.items())
    # a table without rows has no cells
    return reduce(DataFrame.unionByName, found).where("null_ratio IS NOT NULL")


def profile(sampled: DataFrame) -> DataFrame:
    """Cardinality, entropy of value lengths, mean length, numeric ratio, patterns, description."""
    rows = sampled.withColumn("len", F.length("value"))
    lengths = rows.groupBy(*KEY, "len").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy(*KEY))
    entropy = lengths.withColumn("p", F.col("k") / total).groupBy(*KEY).agg(F.round(0.0 - F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))
    in_order = Window.partitionBy(*KEY).orderBy("place")
    rows = rows.withColumn("num", names.number("value")).withColumn("step", F.col("num") - F.lag("num").over(in_order))
    hits = [F.count_if(names.trimmed("value").rlike(p)).alias(f"_{name}") for name, p in names.PATTERNS.items()]
    stats = rows.groupBy(*KEY).agg(
        F.count("*").alias("values"), F.countDistinct("value").alias("cardinality"), F.round(F.avg("len"), 2).alias("avg_len"), F.round(F.count("num") / F.count("*"), 4).alias("numeric_ratio"),
        F.max(F.col("value").contains(".")).alias("_point"), F.min(F.coalesce(F.col("num") == F.floor("num"), F.lit(False))).alias("_whole"),
        (F.max("step") - F.min("step")).alias("_spread"), F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_sample"), *hits,
    )
    least = F.greatest(F.lit(1), F.expr("`values` div 3"))
    found = F.filter(F.array(*(F.when(F.col(f"_{name}") >= least, name) for name in names.PATTERNS)), lambda x: x.isNotNull())
    out = stats.withColumn("patterns", found).withColumn("sample", F.col("_sample.value")).join(entropy, KEY)
    out = out.withColumn("description", description())
    return out.select(*KEY, "values", "cardinality", "entropy", "avg_len", "numeric_ratio", "patterns", "sample", "description")


def description() -> Column:
    """The first that fits: a pattern, kinds of numbers, then length and variety of text."""
    d = {k: F.lit(v) for k, v in DESCRIPTIONS.items()}
    has = lambda name: F.array_contains("patterns", f"{name}_pattern")
    numeric = F.col("numeric_ratio") > 0.8
    sequence = numeric & F.col("_whole") & (F.col("values") >= 3) & (F.col("_spread") < 0.01)
    variety = F.col("cardinality") / F.col("values")
    return (
        F.when(has("date_iso"), d["date"]).when(has("email"), d["email"]).when(has("url"), d["url"]).when(has("uuid"), d["uuid"])
        .when(sequence, d["sequence"]).when(numeric & F.col("_point"), d["decimal"]).when(numeric, d["integer"])
        .when(F.col("avg_len") > 100, d["long"]).when(F.col("avg_len") > 40, d["phrase"])
        .when((variety < 0.5) & (F.col("avg_len") < 20), d["category"]).when((F.col("avg_len") < 20) & (F.col("numeric_ratio") < 0.2), d["short"])
        .otherwise(d["text"])
    )


def value_type(cells: DataFrame) -> DataFrame:
    """BOOL, INT, FLOAT or STRING of each column: INT and FLOAT from 80 % numbers."""
    v = F.lower(names.trimmed("value"))
    rows = cells.where("value IS NOT NULL AND value <> ''")
    stats = rows.groupBy(*KEY).agg(F.avg(v.isin("true", "false").cast("double")).alias("b"), F.avg(v.rlike(r"^[+-]?\d+$").cast("double")).alias("i"), F.avg(names.is_number("value").cast("double")).alias("f"))
    kind = F.when(F.col("b") == 1, "BOOL").when(F.col("i") >= 0.8, "INT").when(F.col("f") >= 0.8, "FLOAT").otherwise("STRING")
    return stats.select(*KEY, kind.alias("type"))


def siblings(columns: DataFrame, most: int = 5) -> DataFrame:
    """The first other columns of each column's table, humanised, in name order."""
    all_names = F.array_sort(F.collect_set("column_name")).alias("all")
    tables = columns.groupBy("source_table").agg(all_names)
    others = F.slice(F.filter("all", lambda x: x != F.col("column_name")), 1, most)
    return columns.join(tables, "source_table").select(*KEY, F.transform(others, lambda x: F.replace(x, F.lit("_"), F.lit(" "))).alias("siblings"))


#: The features of an embedding text, in order.
FEATURES = ("column_name", "column_type", "sample_values", "cardinality", "null_ratio", "value_entropy", "pattern_signals", "avg_value_length", "numeric_ratio", "sibling_context", "source_table", "value_description")


def embedding_text(disabled: tuple[str, ...] = (), type_col: str | None = None) -> Column:
    """Text of a profile (with null_ratio and siblings joined) from the enabled features; the type comes from a column, if it is named."""
    generic = names.is_generic("column_name")
    on = lambda name, cond, text: F.when(cond, text) if name not in disabled else F.lit(None)
    name = F.when(generic & (F.col("description") != ""), F.col("description")).otherwise(names.humanised("column_name"))
    return F.concat_ws(
        " | ",
        on("column_name", name != "", name),
        F.lit(None) if type_col is None else on("column_type", F.col(type_col) != "", F.col(type_col)),
        on("sample_values", F.size("sample") > 0, F.array_join(F.transform(F.slice("sample", 1, 5), lambda v: F.substring(v, 1, 80)), ", ")),
        on("cardinality", F.col("cardinality").isNotNull(), F.format_string("cardinality=%d", "cardinality")),
        on("null_ratio", F.col("null_ratio") > 0, F.format_string("null_ratio=%.2f", "null_ratio")),
        on("value_entropy", F.col("entropy") > 0, F.format_string("entropy=%.2f", "entropy")),
        on("pattern_signals", F.size("patterns") > 0, F.concat(F.lit("patterns: "), F.array_join("patterns", ", "))),
        on("avg_value_length", F.col("avg_len").isNotNull(), F.format_string("avg_len=%.1f", "avg_len")),
        on("numeric_ratio", F.col("numeric_ratio") > 0, F.format_string("numeric=%.2f", "numeric_ratio")),
        on("sibling_context", F.size("siblings") > 0, F.concat(F.lit("siblings: "), F.array_join("siblings", ", "))),
        on("source_table", F.col("source_table") != "", F.concat(F.lit("table="), "source_table")),
        on("value_description", ~generic & (F.col("description") != ""), F.col("description")),
    )


def short_text(name: str, kind: str, values: str) -> Column:
    """name | type | first five values, each cut to 80: what the lexical model reads; text types say nothing and are left out."""
    said = F.when(~F.upper(kind).isin("STRING", "VARCHAR", ""), F.lower(kind))
    some = F.transform(F.slice(values, 1, 5), lambda v: F.substring(v, 1, 80))
    return F.concat_ws(" | ", names.humanised(name), said, F.when(F.size(values) > 0, F.array_join(some, ", ")))


def discrete_vector(emb_dim: int) -> Column:
    """Cardinality, null ratio, entropy and pattern flags, scaled to weigh like an embedding."""
    scale = (emb_dim / (3 + len(names.PATTERNS))) ** 0.5
    values = [F.col("cardinality"), F.coalesce("null_ratio", F.lit(0.0)), F.col("entropy"), *(F.array_contains("patterns", p).cast("int") for p in names.PATTERNS)]
    return F.array(*(v.cast("double") * scale for v in values))


def foreign_keys(columns: DataFrame) -> DataFrame:
    """(source_table, column_name, target_table): <entity>_id to table entity, +s or +es; never itself."""
    name = names.snake("column_name")
    wanted = columns.where(name.endswith("_id")).withColumn("entity", F.regexp_replace(name, "_id$", ""))
    candidates = wanted.select(*KEY, F.posexplode(F.array("entity", F.concat("entity", F.lit("s")), F.concat("entity", F.lit("es")))).alias("place", "candidate"))
    tables = columns.select(F.col("source_table").alias("target_table")).distinct()
    found = candidates.join(tables, F.col("candidate") == F.lower("target_table")).where(F.lower("source_table") != F.col("candidate"))
    return found.groupBy(*KEY).agg(F.min_by("target_table", "place").alias("target_table"))


def elements(columns: DataFrame, least: int = ELEMENT_LEAST) -> DataFrame:
    """(element, source_table, column_name, role): tables with enough columns named like an element's indicators."""
    spark = columns.sparkSession
    words = [(e, w) for e, _, all_words in ELEMENTS for w in all_words]
    indicators = spark.createDataFrame(words, "element string, word string")
    n = F.col("n")
    overlap = F.col("word").contains("_") & (F.size(F.array_except(F.split("word", "_"), F.split(n, "_"))) == 0)
    hit = n.contains(F.col("word")) | F.col("word").contains(n) | overlap
    found = columns.withColumn("n", names.snake("column_name")).join(F.broadcast(indicators), hit).select(*KEY, "element").distinct()
    enough = found.groupBy("source_table", "element").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return found.join(enough, ["source_table", "element"], "left_semi").withColumn("role", names.role("column_name"))


def lookup(found: DataFrame, by: str, **columns: str) -> DataFrame:
    """What `elements` found, read by element, table or column: the distinct values of other columns, joined by commas."""
    return found.groupBy(by).agg(*(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for name, c in columns.items()))
