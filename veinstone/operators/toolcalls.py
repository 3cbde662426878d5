"""Tool calls in the replies of chat models, as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import structure

# The forms in which chat interfaces send calls.
FORMS = "array<struct<id string, name string, arguments string, function struct<name string, arguments string>>>"


def _repaired(raws: pd.Series) -> pd.Series:
    """JSON objects out of what models wrote as arguments; a list becomes the argument `value`, what can't be read null."""

    def one(raw: str | None) -> str | None:
        found = structure.json_object(raw) if raw else None
        if found is None and raw and (listed := structure.json_list(raw)) is not None:
            found = {"value": listed}
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return raws.map(one)


def calls(reply: Column) -> Column:
    """array<struct<id, name, arguments (JSON), unread>> of a reply's `tool_calls`; calls without an id are numbered.

    Arguments that are an object as they stand don't leave the JVM; others are repaired, and what no repair can read is in `unread`.
    """
    found = F.from_json(F.get_json_object(reply, "$.tool_calls"), FORMS)
    raw = lambda c: F.btrim(F.coalesce(c["function"]["arguments"], c["arguments"], F.lit("")))
    return F.transform(found, lambda c, k: F.struct(F.coalesce(c["id"], F.concat(F.lit("call-"), k.cast("string"))).alias("id"), F.coalesce(c["function"]["name"], c["name"], F.lit("")).alias("name"), raw(c).alias("raw")))


def read(raw: Column) -> Column:
    """arguments (a JSON object) and unread of a call's raw arguments; nothing at all is no argument."""
    whole = raw.startswith("{") & F.try_parse_json(raw).isNotNull()
    mended = F.pandas_udf(_repaired, "string")(F.when(~whole & (raw != ""), raw))
    made = F.when(raw == "", "{}").when(whole, raw).otherwise(mended)
    return F.struct(F.coalesce(made, F.lit("{}")).alias("arguments"), F.when(made.isNull(), raw).alias("unread"))
