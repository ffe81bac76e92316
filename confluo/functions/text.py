"""Scalar functions on identity fields, as Column expressions.

Every stored field is a string and a missing value is "".  Python runs only for
Unicode folding, which no built-in function does.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

# What the three stages take for blank.
BLANK_MATCHING = ("", "n/a", "na", "nan", "none", "not available", "null", "unknown")
BLANK_GOLD = ("",)
BLANK_EVALUATION = ("", "nan", "none", "null")
# What the gold stage and the evaluation take for true.
TRUE_GOLD = ("1", "true", "t", "yes", "y")
TRUE_EVALUATION = ("1", "true", "yes", "y")
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")


def strip(c: Column) -> Column:
    """All white space off both ends; null becomes ""."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _clean(c: Column, blanks: tuple[str, ...]) -> Column:
    s = strip(c)
    return F.when(F.lower(s).isin(*blanks), F.lit("")).otherwise(s)


def clean_for_matching(c: Column) -> Column:
    return _clean(c, BLANK_MATCHING)


def clean_for_gold(c: Column) -> Column:
    return _clean(c, BLANK_GOLD)


def clean_for_evaluation(c: Column) -> Column:
    return _clean(c, BLANK_EVALUATION)


@F.pandas_udf(types.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def to_ascii(c: Column) -> Column:
    """Decompose and drop what is not ASCII.  Plain ASCII text skips Python's result."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return _fold(s)


def normalise_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(to_ascii(c)), "[^a-z0-9]", "")


def normalise_email(c: Column) -> Column:
    return F.regexp_replace(F.lower(to_ascii(c)), r"\s+", "")


def normalise_phone(c: Column) -> Column:
    """Digits only, without an international 0044 or 44; ten digits get a 0."""
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\D", "")
    d = F.when(d.startswith("0044"), F.substring(d, 5, 100)).when(d.startswith("44"), F.substring(d, 3, 100)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat(F.lit("0"), d)).otherwise(d)


def normalise_address(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(to_ascii(c)), "[^a-z0-9]+", " "))


def normalise_postcode(c: Column) -> Column:
    return F.regexp_replace(F.upper(to_ascii(c)), "[^A-Z0-9]", "")


def normalise_date(c: Column) -> Column:
    """ISO date by the first format that fits, else ""."""
    s = strip(c)
    return F.coalesce(*[F.date_format(F.try_to_date(s, f), "yyyy-MM-dd") for f in DATE_FORMATS], F.lit(""))


def normalise_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "ß", "ss")), "[^a-z0-9]", "")


def combine_names(first: Column, last: Column) -> Column:
    return strip(F.concat(strip(first), F.lit(" "), strip(last)))


def name_parts(full: Column) -> tuple[Column, Column]:
    """First word and the rest of a name in which "_" may stand for a space."""
    s = F.regexp_replace(F.regexp_replace(strip(full), "_", " "), r"\s+", " ")
    return F.substring_index(s, " ", 1), F.when(F.instr(s, " ") > 0, F.regexp_replace(s, r"^\S+\s*", "")).otherwise(F.lit(""))


def email_parts(email: Column) -> tuple[Column, Column]:
    """Local part and domain, split at the last "@"; both "" without one."""
    has = F.instr(email, "@") > 0
    domain = F.substring_index(email, "@", -1)
    return F.when(has, F.regexp_replace(email, "@[^@]*$", "")).otherwise(""), F.when(has, domain).otherwise("")


def postcode_outward(postcode: Column) -> Column:
    """The code without its last three characters, if it is longer than three."""
    return F.when(F.length(postcode) > 3, postcode.substr(F.lit(1), F.length(postcode) - 3)).otherwise(postcode)


def birth_year(dob: Column) -> Column:
    return F.when(dob.rlike(r"^\d{4}"), F.substring(dob, 1, 4)).otherwise("")


def parse_boolean(c: Column, true: tuple[str, ...] = TRUE_GOLD) -> Column:
    return F.lower(strip(c)).isin(*true)


def parse_hours(c: Column) -> Column:
    """"HH:MM" as decimal hours, null if it is not of that form."""
    parts = F.split(strip(c), ":")
    h, m = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 2) & h.isNotNull() & m.isNotNull(), h + m / 60.0)


def parse_float(c: Column) -> Column:
    return strip(c).try_cast("double")


def joined_list(c: Column) -> Column:
    """Sorted distinct populated values, joined by " | " (an aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(blank_to_null(c))), " | ")


def evidence(**fields: Column) -> Column:
    """JSON object with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def age_on(born: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, born) / 12).cast("int")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_min(c: Column) -> Column:
    return F.coalesce(F.min(blank_to_null(c)), F.lit(""))


def safe_max(c: Column) -> Column:
    return F.coalesce(F.max(blank_to_null(c)), F.lit(""))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def money(c: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(c, 2))


def percent(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.concat(F.format_number(c * 100, 1), F.lit("%")))


def email_name(first: Column, last: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(to_ascii(first)), "[^a-z0-9]", ""), F.lit("."), F.regexp_replace(F.lower(to_ascii(last)), "[^a-z0-9]", ""))
