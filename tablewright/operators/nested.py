"""Flatten nested structs into plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Fields of structs at any depth become columns named ``a<sep>b<sep>c``."""

    def walk(fields, parent: Column | None, prefix: str):
        for field in fields:
            c = ref(field.name) if parent is None else parent.getField(field.name)
            name = f"{prefix}{separator}{field.name}" if prefix else field.name
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType.fields, c, name)
            else:
                yield c.alias(name)

    return df.select(*walk(df.schema.fields, None, ""))
