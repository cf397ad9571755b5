"""Canonical JSON as column expressions: sorted keys, ASCII alone, no spaces.

A value of a table becomes the same text as Python's ``json.dumps(..., sort_keys=True, ensure_ascii=True,
separators=(",", ":"))`` of the same value, so digests made in a job and on a driver agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JSON's short escapes (fixed values).
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_text(value: Column) -> Column:
    """A string in quotes: what isn't printable ASCII as ``\\uXXXX`` in lower case, beyond the basic plane in pairs."""
    def escaped(part: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(.{4})", r"\\u$1")
        for plain, short in _SHORT.items():
            out = F.when(part == plain, F.lit(short)).otherwise(out)
        return F.when(part.rlike(r"\A[ !#-\[\]-~]"), part).otherwise(out)

    plain = F.concat(F.lit('"'), value, F.lit('"'))
    # Runs of plain characters stay as they are; of the others each is a part of its own.
    parts = F.regexp_extract_all(value, F.lit(r"(?s)[ !#-\[\]-~]+|."), F.lit(0))
    slow = F.concat(F.lit('"'), F.array_join(F.transform(parts, escaped), ""), F.lit('"'))
    return F.when(value.rlike(r'\A[ !#-\[\]-~]*\z'), plain).otherwise(slow)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of this type: texts, whole numbers, truth values, arrays and structs of them,
    and maps with text keys. Nulls are ``null``, also within arrays and structs.

    Other types have no canonical text and are refused: fractions print in more than one way.
    """
    if isinstance(kind, T.StringType):
        out = json_text(value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        out = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), *[x for i, p in enumerate(parts) for x in ([F.lit(","), p] if i else [p])], F.lit("}"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value))
        text = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def digest(value: Column, kind: T.DataType, tag: str = "") -> Column:
    """SHA-256 of the canonical text, after a tag and a line feed where there is one."""
    text = canonical_json(value, kind)
    return F.sha2(F.concat(F.lit(f"{tag}\n"), text) if tag else text, 256)
