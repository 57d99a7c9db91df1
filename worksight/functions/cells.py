"""Cells of raw exports as typed columns: null tokens, text, numbers, money with units, dates. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATE_FORMATS, NULL_TOKENS

_BLANK = r"^[\s ]+|[\s ]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _BLANK, "")


def null_if_token(c: Column) -> Column:
    """The stripped text; null for the spellings of "nothing"."""
    s = stripped(c)
    return F.when(~F.lower(s).isin(*NULL_TOKENS), s)


def norm_text(c: Column) -> Column:
    return F.regexp_replace(null_if_token(c), r"[\s ]+", " ")


def header_key(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as `_`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(norm_text(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def _number(c: Column, to: str) -> Column:
    plain = F.trim(F.regexp_replace(c, "[,₹]", ""))
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast(to))


def norm_int(c: Column) -> Column:
    """A count; `No.` before it goes, decimals are cut."""
    text = F.regexp_replace(null_if_token(c), r"^(No\.|no\.|No|no)", "")
    return F.when(_number(text, "decimal(38,6)") >= 0, F.floor(_number(text, "decimal(38,6)"))).otherwise(F.ceil(_number(text, "decimal(38,6)"))).cast("bigint")


def norm_decimal(c: Column, to: str = "decimal(20,4)") -> Column:
    return _number(null_if_token(c), to)


def norm_pct(c: Column) -> Column:
    """A percentage as it stands, never clamped; one `%` at the end goes."""
    return norm_decimal(F.regexp_replace(null_if_token(c), r"\s*%$", ""))


def norm_money(c: Column) -> Column:
    """struct<value, unit>: the first number and the unit it is counted in (RUPEE, LAKH or CRORE)."""
    upper = F.upper(null_if_token(c))
    token = F.regexp_extract(upper, r"(CRORES?|LAKHS?|CR|L)\b", 1)
    unit = F.when(token.startswith("CR"), "CRORE").when(token.startswith("L"), "LAKH").otherwise("RUPEE")
    rest = F.regexp_replace(F.regexp_replace(upper, r"(CRORES?|LAKHS?|CR|L)\b", " "), r"₹|RS\.|RS|INR", " ")
    chunks = F.split(F.trim(F.regexp_replace(F.regexp_replace(rest, ",", ""), r"[^0-9.\-]", " ")), r"\s+")
    numbers = F.filter(chunks, lambda x: x.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"))
    return F.struct(F.get(numbers, F.lit(0)).try_cast("decimal(20,4)").alias("value"), F.coalesce(unit, F.lit("RUPEE")).alias("unit"))


def to_rupees(value: Column, unit: Column) -> Column:
    factor = F.when(unit == "RUPEE", F.lit(1)).when(unit == "LAKH", F.lit(100_000)).when(unit == "CRORE", F.lit(10_000_000))
    return (value * factor).cast("decimal(30,4)")


def parse_numeric(c: Column) -> Column:
    """A number of the older import path: `CR` and `L` at the end multiply at once."""
    plain = F.regexp_replace(F.trim(c.cast("string")), "[₹, ]", "")
    upper = F.upper(plain)
    of = lambda cut: _number(F.substring(plain, F.lit(1), F.length(plain) - cut), "decimal(20,4)")
    return F.when(upper.endswith("CR"), of(2) * 10_000_000).when(upper.endswith("L"), of(1) * 100_000).otherwise(_number(plain, "decimal(20,4)")).cast("decimal(30,4)")


def norm_date(c: Column, formats=DATE_FORMATS) -> Column:
    """The first of the formats that reads the cell."""
    text = null_if_token(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def fmt_lakh(c: Column) -> Column:
    return F.format_string("₹%.1fL", c.cast("double") / 100_000)
