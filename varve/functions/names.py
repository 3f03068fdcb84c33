"""Column names and values: words, patterns, kinds, types. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names of value patterns and what they match (trimmed values); by name, since results list them sorted
PATTERNS = {
    "credit_card_pattern": r"^\d{13,19}$",
    "date_iso_pattern": r"^\d{4}-\d{2}-\d{2}",
    "email_pattern": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "ipv4_pattern": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "phone_pattern": r"^[\+]?[\d\s\-\(\)\.]{7,20}$",
    "ssn_pattern": r"^\d{3}-\d{2}-\d{4}$",
    "url_pattern": r"^https?://",
    "uuid_pattern": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
#: Names that say nothing of their column.
GENERIC = r"(?i)^(col\d*|column\d*|field\d*|var\d*|unnamed.*|\d+|_|)$"
#: What counts as a number: thousands commas allowed, no underscores, no words.
NUMBER = r"^[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Words of a name that tell its role: endings, or parts.
IDENTIFIER, TEMPORAL, REFERENCE = "_id", "date|time|created|updated", "_ref|_fk"
#: Beginnings of names of annotation columns, when only digits and _ follow, a digit first.
ANNOTATION_PREFIXES = ("attr_", "ref_", "code_", "var_", "key_", "val_", "data_", "field_", "col_", "item_")
#: The simple type that an engine's type is, by words that its name holds, the first that fits.
ENGINE_TYPES = (("int", "INT"), ("float", "FLOAT"), ("double", "FLOAT"), ("decimal", "FLOAT"), ("utf8", "STRING"), ("string", "STRING"), ("bool", "BOOL"), ("timestamp", "TIMESTAMP"), ("date32", "TIMESTAMP"), ("date64", "TIMESTAMP"))
# --- end of fixed values


def trimmed(value: str) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def humanised(name: str) -> Column:
    return F.replace(F.col(name), F.lit("_"), F.lit(" "))


def snake(name: str) -> Column:
    return F.replace(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), F.lit("-"), F.lit("_"))


def camel_words(label: str) -> Column:
    return F.lower(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"))


def is_generic(name: str) -> Column:
    return trimmed(name).rlike(GENERIC)


def role(name: str) -> Column:
    """identifier, temporal, reference or attribute, from the name."""
    n = snake(name)
    return F.when(n.endswith(IDENTIFIER) | (n == IDENTIFIER[1:]), "identifier").when(n.rlike(TEMPORAL), "temporal").when(n.rlike(REFERENCE), "reference").otherwise("attribute")


def kind(name: str) -> Column:
    """row_id, annotation (a known beginning and a number) or data."""
    number = f"^({'|'.join(ANNOTATION_PREFIXES)})[0-9][0-9_]*$"
    return F.when(F.col(name) == "row_id", "row_id").when(F.col(name).rlike(number), "annotation").otherwise("data")


def engine_type(name: str) -> Column:
    """INT, FLOAT, STRING, BOOL or TIMESTAMP of an engine's type name, without what stands in brackets; others are STRING."""
    base = F.lower(F.trim(F.regexp_replace(name, r"[\[(].*$", "")))
    out = F.lit("STRING")
    for part, simple in reversed(ENGINE_TYPES):
        out = F.when(base.contains(part), simple).otherwise(out)
    return out


def is_number(value: str) -> Column:
    return trimmed(value).rlike(NUMBER)


def number(value: str) -> Column:
    """The number a value is, or null."""
    return F.when(is_number(value), F.replace(trimmed(value), F.lit(","), F.lit("")).try_cast("double"))
