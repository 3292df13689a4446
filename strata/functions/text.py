"""Text columns: white space, stamps, null-safe digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(c: Column | str) -> Column:
    """A run of space, tab, CR and LF becomes one space, ends are trimmed, an empty text becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " ")), F.lit(""))


def stamp(c: Column | str) -> Column:
    """A timestamp as yyyyMMdd_HHmmss. By way of its text, so the session's time zone plays no part."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19), " -:", "_")


def digest(*cols: Column | str, seed: int = 0) -> Column:
    """A 64-bit digest in which null differs from every value and from a null elsewhere (xxhash64 skips nulls)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(F.lit(seed), *[x for c in cs for x in (c.isNull(), c)])


def hashed_parts(c: Column, kind: T.DataType) -> list[Column]:
    """What `digest` must see of a column so that different values differ: of arrays also their sizes and nulls at every depth, of
    structs their fields, of maps their entries in order of keys."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.ArrayType, T.StructType, T.MapType)):
            return [F.size(c), F.transform(c, lambda x: digest(*hashed_parts(x, inner), seed=1)), F.transform(c, lambda x: digest(*hashed_parts(x, inner), seed=2))]
        return [F.size(c), F.transform(c, lambda x: x.isNull()), c]
    if isinstance(kind, T.StructType):
        return [c.isNull(), *[p for f in kind.fields for p in hashed_parts(c[f.name], f.dataType)]]
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return hashed_parts(F.array_sort(F.map_entries(c)), entries)
    return [c]
