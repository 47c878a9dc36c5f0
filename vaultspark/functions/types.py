"""A lattice of types: what holds the values of two types, whichever comes first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

#: Chains from narrow to wide; what is in no common chain becomes a string.
_CHAINS = ((ByteType, ShortType, IntegerType, LongType, DoubleType), (FloatType, DoubleType), (DateType, TimestampNTZType, TimestampType))


def _digits(t: DataType) -> tuple[int, int] | None:
    """Digits before and after the point of an exact number."""
    if isinstance(t, DecimalType):
        return t.precision - t.scale, t.scale
    return {ByteType: (3, 0), ShortType: (5, 0), IntegerType: (10, 0), LongType: (20, 0)}.get(type(t))


def wider(a: DataType, b: DataType) -> DataType:
    """The least type that both go into: commutative and associative, so drops in any order give one type. A long beside a double is a double;
    types that nothing else holds are strings."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(wider(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType), True)
    kinds = {type(a), type(b)}
    if DecimalType in kinds and kinds & {DoubleType, FloatType}:
        return DoubleType()
    if DecimalType in kinds and _digits(a) and _digits(b):
        whole, point = map(max, zip(_digits(a), _digits(b)))
        return DecimalType(whole + point, point) if whole + point <= 38 else DoubleType()
    if FloatType in kinds and kinds & {ByteType, ShortType, IntegerType, LongType}:
        return DoubleType()
    for chain in _CHAINS:
        if kinds <= set(chain):
            return max(kinds, key=chain.index)()
    return StringType()


def merged(a: StructType, b: StructType) -> StructType:
    """The columns of a, widened by those of b with the same name, then those that only b has. All may be null."""
    other = {f.name: f for f in b.fields}
    own = [StructField(f.name, wider(f.dataType, other[f.name].dataType) if f.name in other else f.dataType) for f in a.fields]
    names = {f.name for f in a.fields}
    return StructType(own + [StructField(f.name, f.dataType) for f in b.fields if f.name not in names])


def unified(frames: list[DataFrame]) -> DataFrame:
    """The rows of all, in the least schema that holds them; a column that some lack is null there."""
    schema = reduce(merged, (f.schema for f in frames))

    def fit(df: DataFrame) -> DataFrame:
        known = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*[(F.col(f.name) if known.get(f.name) == f.dataType else F.col(f.name).cast(f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    return reduce(DataFrame.unionByName, map(fit, frames))
