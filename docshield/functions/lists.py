"""List-valued metadata (P2, P6) and other small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(arr: Column) -> Column:
    return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")


#: Strings inside strings that are parsed as JSON again: each level doubles the backslashes in front of a quote.
QUOTED_LEVELS = 3


def _said(x: Column) -> Column:
    """A JSON value as the original writes it: True, False and None by their names."""
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").otherwise(text)


def normalize_list(value) -> Column:
    """Null → [], JSON text → its items, else comma split; items are trimmed and blanks dropped.

    A JSON array gives its items, a JSON string is normalised in turn (a quoted list, or a
    quoted ``a, b``), JSON ``null`` is no item, and any other JSON value is one item.
    Malformed JSON falls back to the comma split, as a failed JSON parse does in the original.
    """
    return _normalized(F.trim(_col(value).cast("string")), QUOTED_LEVELS)


def _normalized(s: Column, levels: int) -> Column:
    none, plain = F.array().cast("array<string>"), _clean(F.split(s, ",", -1))
    v = F.try_parse_json(s)
    kind = F.schema_of_variant(v)
    quoted = _normalized(F.trim(F.try_variant_get(v, "$", "string")), levels - 1) if levels else plain
    json = (F.when(v.isNull(), plain).when(kind == "VOID", none).when(kind == "STRING", quoted)
            .when(kind.startswith("ARRAY"), _clean(F.transform(F.try_variant_get(v, "$", "array<variant>"), _said))).otherwise(F.array(_said(v))))
    return F.when(s.isNull() | (s == ""), none).when(s.rlike(r'^(?:["\[{0-9-]|true$|false$|null$)'), json).otherwise(plain)


def acl_roles_or_default(value, default=("employee",)) -> Column:
    """Normalised roles, defaulting when nothing is left."""
    n = normalize_list(value)
    return F.when(F.size(n) == 0, F.array(*[F.lit(d) for d in default])).otherwise(n)


def short_doc_id(text) -> Column:
    """First 16 hex chars of SHA-256 of the text."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def flatten_schema(df, sep: str = "."):
    """Nested struct fields become top-level columns with dotted names."""
    from pyspark.sql.types import StructType

    def walk(schema, prefix):
        out = []
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                out.extend(walk(f.dataType, path + "."))
            else:
                out.append(path)
        return out

    cols = walk(df.schema, "")
    return df.select(*[F.col(".".join(f"`{p}`" for p in c.split("."))).alias(c.replace(".", sep))
                       for c in cols])
