"""Table readers chosen by file extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tablewright.functions.columns import chunks, ref, scrub_nonfinite

# Texts that mean a missing value in a CSV file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?)\s*$"
BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def _text_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Header row, every value a text, missing texts NULL. A file with multi-line records is read by one task."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line,
                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return raw.select(*[F.when(~ref(c).isin(MISSING_TEXTS), ref(c)).alias(c) for c in raw.columns])


def _given_csv(raw: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema by their header names; what is absent or doesn't fit its type is NULL."""
    return raw.select(*[(F.lit(None) if f.name not in raw.columns else ref(f.name) if f.dataType.simpleString() == "string"
                         else F.trim(ref(f.name)).try_cast(f.dataType)).cast(f.dataType).alias(f.name)
                        for f in StructType.fromDDL(schema).fields])


def _typed_csv(raw: DataFrame) -> DataFrame:
    """bigint, double, boolean or string per column, from one aggregate over all rows.

    Dates stay text, as do columns of whole numbers of which one doesn't fit 64 bits.
    """
    if not raw.columns:
        return raw
    types = {}
    for part in chunks(raw.columns, 16):
        wanted = []
        for c in part:
            x = ref(c)
            wanted += [F.count(x), F.count(F.when(x.rlike(INTEGER), F.trim(x).try_cast("bigint"))), F.count(F.when(x.rlike(INTEGER), 1)),
                       F.count(F.when(x.rlike("(?i)" + DECIMAL), 1)),
                       F.count(F.when(x.rlike(BOOLEAN), 1))]
        row = raw.agg(*[w.alias(f"a{i}") for i, w in enumerate(wanted)]).first()
        for i, c in enumerate(part):
            n, whole, digits, decimal, boolean = row[5 * i:5 * i + 5]
            types[c] = ("string" if not n or digits == n > whole else "bigint" if whole == n else "double" if decimal == n
                        else "boolean" if boolean == n else "string")
    return raw.select(*[(ref(c) if t == "string" else F.trim(ref(c)).cast(t)).alias(c)
                        for c, t in types.items()])


def read_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True
               ) -> DataFrame:
    """Read a table and turn infinities and NaN into NULL.

    .json holds an array of records (or one record a line with multi_line=False), .jsonl and
    .ndjson one record a line, .parquet is read as it is, any other extension is CSV. Give a
    schema to spare CSV and JSON the inference pass. CSV records may hold quoted line breaks;
    such files cannot be split among tasks, multi_line=False reads files without them in parts.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension in (".xlsx", ".xls"):
        raise ValueError("spreadsheets are not read; export the sheet to CSV")
    if extension == ".parquet":
        df = spark.read.parquet(path)
    elif extension in (".json", ".jsonl", ".ndjson"):
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.json(path, multiLine=multi_line and extension == ".json")
    else:
        raw = _text_csv(spark, path, multi_line)
        df = _given_csv(raw, schema) if schema else _typed_csv(raw)
    return scrub_nonfinite(df)
