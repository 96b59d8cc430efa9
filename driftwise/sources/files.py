"""CSV and Parquet scans and sinks (plain Spark readers and writers).

CSV written here reads back unchanged and splits.  Spark's CSV defaults lose data:
the writer trims blanks around values, an empty string and a null are both written
as nothing, timestamps keep only milliseconds, a line of blanks is skipped, and a
value with a line break needs a multi-line read, which is one task a file.  So every
value is quoted, a null is written as ``\\N`` (the usual marker of Hive and database
exports), and text is escaped reversibly before it is written: a backslash, a line
feed, a carriage return and a NUL become ``\\\\``, ``\\n``, ``\\r`` and ``\\0``.  No line
break is left in a file but those between rows, and a text ``\\N`` is ``\\\\N``, which
is no null.  :func:`read_exact_csv` undoes the escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.sqltext import col

CSV_TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CSV_EXACT_OPTIONS = {
    **CSV_TIME_OPTIONS,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N",
    "quoteAll": "true",
    "escape": '"',      # a quote inside a value is doubled; backslashes are ours
}
# Fixed values of the written form: what a character becomes (backslash first).
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))


def escape_breaks(c: Column) -> Column:
    """Text without line breaks and NULs; :func:`restore_breaks` undoes it."""
    for raw, written in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def restore_breaks(c: Column) -> Column:
    """Text as it was before :func:`escape_breaks`."""
    def part(x: Column) -> Column:
        for raw, written in ESCAPES[1:]:
            x = F.replace(x, F.lit(written), F.lit(raw))
        return x

    # a doubled backslash is cut out first, so no other escape can begin with its second half
    whole = F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")
    return F.when(F.contains(c, F.lit("\\")), whole).otherwise(c)


def _text_columns(schema: T.StructType) -> set[str]:
    return {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, sep: str = ",", **options) -> DataFrame:
    """CSV with a header line, as others write it.  Leading blanks after the
    separator are ignored (``a, 1`` reads as ``a`` and ``1``).  Pass ``schema`` for real
    jobs; without it types are inferred, which costs an extra pass.  A cell that
    does not convert and a row of another width raise (``mode="PERMISSIVE"``: null)."""
    reader = (spark.read.option("header", header).option("sep", sep).option("mode", "FAILFAST")
                   .option("ignoreLeadingWhiteSpace", True)
                   .options(**{k: str(v) for k, v in options.items()}))
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", **options) -> None:
    """Lossless CSV with a header line and no index column; one file per partition,
    read back with :func:`read_exact_csv`."""
    text = _text_columns(df.schema)
    cells = [(escape_breaks(col(n)) if n in text else col(n)).alias(escape_name(n)) for n in df.columns]
    (df.select(*cells).write.mode(mode).option("header", header).options(**{**CSV_EXACT_OPTIONS, **options}).csv(path))


def escape_name(name: str) -> str:
    for raw, written in ESCAPES:
        name = name.replace(raw, written)
    return name


def read_exact_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, **options) -> DataFrame:
    """A CSV written by :func:`write_csv`, unchanged.  Files split: a row is a line.
    A cell that does not convert and a row of another width raise."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    lines = T.StructType([T.StructField(escape_name(f.name), f.dataType) for f in schema.fields])
    rows = (spark.read.schema(lines).option("header", header).option("mode", "FAILFAST")
            .options(**{**CSV_EXACT_OPTIONS, **{k: str(v) for k, v in options.items()}}).csv(path))
    text = _text_columns(schema)
    return rows.select(*[(restore_breaks(col(escape_name(n))) if n in text else col(escape_name(n))).alias(n) for n in schema.names])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                   schema: T.StructType | str | None = None, *, exact: bool = False, **options) -> DataFrame:
    """Convert a CSV table to Parquet and return the Parquet scan; ``exact`` for a
    CSV written by :func:`write_csv` (needs ``schema``)."""
    if exact and schema is None:
        raise ValueError("the exact form is read with a schema")
    rows = read_exact_csv(spark, csv_path, schema, **options) if exact else read_csv(spark, csv_path, schema, **options)
    write_parquet(rows, parquet_path)
    return read_parquet(spark, parquet_path)
