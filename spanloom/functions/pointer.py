"""JSON pointers (RFC 6901) over JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_INDEX = re.compile(r"0|[1-9][0-9]*")


def resolve_constant(document: Column, pointer: str) -> Column:
    """The value at a pointer known when the plan is built, as JSON text; NULL where there is none.

    A JSON null is a value: it comes back as the text ``null``.
    """
    path = "$"
    for token in pointer.split("/")[1:]:
        name = token.replace("~1", "/").replace("~0", "~")
        path += f"[{name}]" if _INDEX.fullmatch(name) else "['" + name.replace("'", "\\'") + "']"
    found = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return F.to_json(found)


def is_pointer(text: Column) -> Column:
    """Whether a text is a pointer: empty, or tokens behind slashes with ~ as ~0 and ~1 only. False for NULL."""
    return F.coalesce(text.rlike(r"^(/([^~/]|~[01])*)*$"), F.lit(False))


#: Stands for a document that isn't JSON.
_NO_JSON = object()


def read_json(document: str | None) -> object:
    """A document's value, for :func:`json_at`."""
    try:
        return _NO_JSON if document is None else json.loads(document)
    except ValueError:
        return _NO_JSON


def json_at(value: object, pointer: str | None) -> str | None:
    """JSON text of the part of a read document at ``pointer``, or None."""
    if value is _NO_JSON or pointer is None or (pointer and not pointer.startswith("/")):
        return None
    for token in pointer.split("/")[1:]:
        if re.search(r"~(?![01])", token):
            return None
        name = token.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and name in value:
            value = value[name]
        elif isinstance(value, list) and _INDEX.fullmatch(name) and int(name) < len(value):
            value = value[int(name)]
        else:
            return None
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def at_pointer(document: str | None, pointer: str | None) -> str | None:
    """JSON text of the value at ``pointer``, or None."""
    return json_at(read_json(document), pointer)


@F.pandas_udf(StringType())
def resolve_dynamic(document: pd.Series, pointer: pd.Series) -> pd.Series:
    """The value at a pointer that differs by row, as canonical JSON."""
    return pd.Series([at_pointer(d, p) for d, p in zip(document, pointer)], dtype=object)


@F.pandas_udf(StringType())
def canonical_json(document: pd.Series) -> pd.Series:
    """Sorted keys and no white space; None for what isn't JSON."""
    return pd.Series([at_pointer(d, "") for d in document], dtype=object)
