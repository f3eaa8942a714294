"""The 22 column types and their Spark fields. A vector's dimension is part of its type and lives in the metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_complex = {"32": T.FloatType(), "64": T.DoubleType()}
_pair = {k: T.StructType([T.StructField("re", v), T.StructField("im", v)]) for k, v in _complex.items()}

#: Type names and their Spark types (fixed values).
TYPES: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(),
    "BYTE": T.ByteType(),
    "SHORT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "LONG": T.LongType(),
    "DATE": T.TimestampType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "UUID": T.StringType(),
    "COMPLEX32": _pair["32"],
    "COMPLEX64": _pair["64"],
    "BYTESTRING": T.BinaryType(),
    "BOOLEAN_VECTOR": T.ArrayType(T.BooleanType(), False),
    "SHORT_VECTOR": T.ArrayType(T.ShortType(), False),
    "INTEGER_VECTOR": T.ArrayType(T.IntegerType(), False),
    "LONG_VECTOR": T.ArrayType(T.LongType(), False),
    "HALF_VECTOR": T.ArrayType(T.FloatType(), False),
    "FLOAT_VECTOR": T.ArrayType(T.FloatType(), False),
    "DOUBLE_VECTOR": T.ArrayType(T.DoubleType(), False),
    "COMPLEX32_VECTOR": T.ArrayType(_pair["32"], False),
    "COMPLEX64_VECTOR": T.ArrayType(_pair["64"], False),
}
ALIASES = {"INT": "INTEGER"}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    dim: int = 0
    nullable: bool = True
    primary: bool = False
    auto_increment: bool = False

    def field(self) -> T.StructField:
        kind = ALIASES.get(self.type.upper(), self.type.upper())
        if kind not in TYPES:
            raise ValueError(f"unknown type {self.type}")
        if kind.endswith("_VECTOR") and self.dim <= 0:
            raise ValueError(f"{self.name}: a vector needs a dimension above 0")
        if self.auto_increment and kind not in ("INTEGER", "LONG"):
            raise ValueError(f"{self.name}: only INTEGER and LONG columns count up")
        told = {"kind": kind, "dim": self.dim, "primary": self.primary, "auto_increment": self.auto_increment}
        return T.StructField(self.name.lower(), TYPES[kind], self.nullable, told)


def schema_of(columns: list[ColumnDef]) -> T.StructType:
    names = [c.name.lower() for c in columns]
    if len(set(names)) < len(names) or not names:
        raise ValueError("columns need distinct names")
    return T.StructType([c.field() for c in columns])
