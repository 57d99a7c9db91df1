"""Canonical JSON as columns: the text that Python's json.dumps gives with sorted keys and without ASCII escapes."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..tasks import ship

ship(__name__)
#: Between items and after keys: as json.dumps writes by default, and without blanks.
WIDE, TIGHT = (", ", ": "), (",", ":")
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(c: Column) -> Column:
    """A text in quotes, with control characters as short escapes or in lower-case hex; a null is null."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = reduce(lambda x, k: F.replace(x, F.lit(chr(k)), F.lit(_SHORT.get(chr(k), f"\\u{k:04x}"))), range(32), plain)
    # control characters are rare, so the many replacements are made where one is
    body = F.when(c.rlike("[\\x00-\\x1F]"), rare).otherwise(plain)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_object(fields: dict[str, Column], style: tuple[str, str] = WIDE) -> Column:
    """An object of fields that are JSON already, by name."""
    item, key = style
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + key), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(item, *parts), F.lit("}"))


def json_map(c: Column, style: tuple[str, str] = WIDE) -> Column:
    """A map of texts as an object, its keys in order; a null is null."""
    item, key = style
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(json_text(e["key"]), F.lit(key), json_text(e["value"])))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(pairs, item), F.lit("}")))


def json_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def canonical(text: str | None) -> str | None:
    """JSON text with sorted keys and no blanks. A text that is no JSON stays as it is."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=TIGHT, ensure_ascii=False)
    except ValueError:
        return text


def canonical_json(c: Column) -> Column:
    """canonical() of a column, by Arrow batches; how Python writes numbers has no counterpart among Spark's functions."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        known = {t: canonical(t) for t in texts.unique()}
        return texts.map(known)

    return run(c)
