"""JSON fields with the reference semantics: only JSON strings count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _string_at(document: Column, path: str) -> Column:
    found = F.try_variant_get(document, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(document, path, "string"))


def _quoted(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def field_value(document: Column, field: str) -> Column:
    """A field's string: under the key as it stands (dots and all), else along the dotted path; null where neither is one.

    document: a VARIANT.
    """
    found = _string_at(document, "$" + _quoted(field))
    return F.coalesce(found, _string_at(document, "$" + "".join(map(_quoted, field.split("."))))) if "." in field else found
