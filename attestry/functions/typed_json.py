"""JSON read by type: a value of another JSON type is NULL, never converted.

``from_json`` turns a number into text where text is asked for, so it cannot tell a
valid answer from one that only looks like it. Here the text is parsed once and every
leaf is compared with the type that its field names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import let

#: JSON type names of the leaf types.
_LEAVES = {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT"}


def _read(value: Column, kind: T.DataType, path: str = "$") -> Column:
    """What ``value`` has at ``path``, by type. An object is bound once for all its fields."""
    if isinstance(kind, T.StructType):
        def fields(held: Column) -> Column:
            read = [_read(held, f.dataType, f"$.{f.name}").alias(f.name) for f in kind.fields]
            return F.when(F.startswith(F.schema_of_variant(held), F.lit("OBJECT")), F.struct(*read))

        return let(value if path == "$" else F.try_variant_get(value, path, "variant"), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(value, path, "array<variant>"), lambda item: _read(item, kind.elementType))
    name = kind.simpleString()
    found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(found == _LEAVES[name], F.try_variant_get(value, path, name))


def typed_json(text: Column, schema: str) -> Column:
    """``text`` as a struct of ``schema`` (strings, booleans, bigints, arrays, structs).

    Text that is no JSON object, or names a key twice, is NULL; so is each field or item
    whose JSON type differs. Unknown keys are ignored.
    """
    return _read(F.try_parse_json(text), T.StructType.fromDDL(schema))
