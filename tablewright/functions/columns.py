"""Column kinds, safe references and the non-finite scrub every operator starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
FRACTIONAL_TYPES = (T.DoubleType, T.FloatType)

# Width in bytes of one value, for the size estimate of fixed-width columns.
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4,
    "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8,
}


def ref(name: str) -> Column:
    """Column by exact name, also where the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(data_type: T.DataType) -> str:
    """boolean, datetime, numeric, string or unsupported."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, DATETIME_TYPES):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "unsupported"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric here."""
    return [c for c, kind in families(df).items() if kind == "numeric" and c not in exclude]


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(~bad, column)


def scrub_nonfinite(df: DataFrame) -> DataFrame:
    """NULL in place of NaN and +-inf in every float and double column."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL_TYPES)]
    return df.withColumns({c: finite(ref(c)) for c in fractional}) if fractional else df


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a finite double or NULL."""
    data_type = df.schema[name].dataType
    column = ref(name).cast("double")
    return finite(column) if isinstance(data_type, FRACTIONAL_TYPES) else column


def chunks(items: list, size: int):
    for start in range(0, len(items), size):
        yield items[start:start + size]
