"""Table equality: names, types and contents, and the write-and-read-back
check built on it.

Contents are compared as multisets of rows with nulls equal.  Every row becomes a
128-bit digest (:mod:`driftwise.functions.digest`) with a sign, +1 on the left and
-1 on the right; one aggregation adds the signs up per digest, and a digest whose
signs do not cancel is a difference.  So the shuffle carries 24 bytes a row, however
wide the table is, and a row repeated in a third of the table is one row a task.
Whole rows are read again only where they are asked for (:func:`row_differences`),
and only those whose digest did not cancel.  Two different rows share a digest with
a chance of 2**-128 a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.digest import digest, type_text
from driftwise.functions.scalar import verdict
from driftwise.functions.sqltext import col
from driftwise.session import scratch_path
from driftwise.sources.files import CSV_TIME_OPTIONS, read_exact_csv, write_csv

_W, _D1, _D2 = "_w", "_d1", "_d2"
LEFT, RIGHT = 1, -1
BROADCAST_ROWS = 1_000_000      # digests of 16 bytes


def names_differences(a: T.StructType, b: T.StructType) -> int:
    """Positions whose column names differ (a length difference counts too)."""
    na, nb = a.names, b.names
    return sum(x != y for x, y in zip(na, nb)) + abs(len(na) - len(nb))


def types_differences(a: T.StructType, b: T.StructType) -> int:
    """Positions whose types differ (nullability ignored)."""
    ta = [type_text(f.dataType) for f in a.fields]
    tb = [type_text(f.dataType) for f in b.fields]
    return sum(x != y for x, y in zip(ta, tb)) + abs(len(ta) - len(tb))


def _digests(df: DataFrame, sign: int, *more: Column) -> DataFrame:
    halves = digest([(col(f.name), f.dataType) for f in df.schema.fields])
    return df.select(halves[0].alias(_D1), halves[1].alias(_D2), F.lit(sign).alias(_W), *more)


def _positional(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    if len(a.columns) != len(b.columns):
        raise ValueError("tables have different numbers of columns")
    names = [f"c{i}" for i in range(len(a.columns))]
    return a.toDF(*names), b.toDF(*names)


def _signed(a: DataFrame, b: DataFrame) -> DataFrame:
    """``_d1, _d2, _d``: how many more rows of a digest the left side has."""
    left, right = _positional(a, b)
    return _digests(left, LEFT).unionByName(_digests(right, RIGHT)).groupBy(_D1, _D2).agg(F.sum(_W).alias("_d"))


def _only(sign: int) -> Column:
    d = F.col("_d") * sign
    return F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).cast("bigint")


def content_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``only_left, only_right``: rows (with multiplicity) found in
    one table and not the other.  Columns are matched by position; rows of
    different types are different."""
    return _signed(a, b).agg(_only(LEFT).alias("only_left"), _only(RIGHT).alias("only_right"))


def row_differences(a: DataFrame, b: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The differing rows themselves: ``only_left, only_right`` and the columns, each
    distinct row once, under the left names.

    The digests that do not cancel are written down and counted.  Up to
    ``broadcast_rows`` of them go to every task, and whole rows are shuffled only
    after that filter; beyond it rows are joined with them by shuffle.
    """
    if types_differences(a.schema, b.schema):
        raise ValueError("rows of different types cannot be listed together")
    spark, (left, right) = a.sparkSession, _positional(a, b)
    path = scratch_path(spark, "differing-digests")
    _signed(a, b).where("_d <> 0").write.parquet(path)
    changed = spark.read.parquet(path)
    near = changed.count() <= broadcast_rows
    names = left.columns
    rows = _digests(left, LEFT, F.struct(*names).alias("_row")).unionByName(_digests(right, RIGHT, F.struct(*names).alias("_row")))
    rows = rows.join(F.broadcast(changed) if near else changed, [_D1, _D2])
    return (rows.groupBy(_D1, _D2).agg(F.first("_row").alias("_row"), F.first("_d").alias("_d"))
            .select(F.greatest("_d", F.lit(0)).cast("bigint").alias("only_left"), F.greatest(-F.col("_d"), F.lit(0)).cast("bigint").alias("only_right"),
                    *[F.col(f"_row.c{i}").alias(n) for i, n in enumerate(a.columns)]))


def column_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which columns differ, one row a position:
    ``position, left_column, right_column, same_name, same_type, only_left, only_right``.

    ``only_left`` and ``only_right`` count the column's values (with multiplicity)
    that the other side's column lacks; null where the types differ or one side has
    no such column.  All columns are counted in one pass: every row becomes one
    digest a column, added up per (position, digest).
    """
    spark = a.sparkSession
    fields = list(zip(a.schema.fields, b.schema.fields))
    alike = [i for i, (x, y) in enumerate(fields) if type_text(x.dataType) == type_text(y.dataType)]
    n = max(len(a.columns), len(b.columns))
    names = [[df.columns[i] if i < len(df.columns) else None for i in range(n)] for df in (a, b)]
    schema = spark.createDataFrame(
        [(i, names[0][i], names[1][i], names[0][i] == names[1][i], i in alike) for i in range(n)],
        "position int, left_column string, right_column string, same_name boolean, same_type boolean")
    if not alike:
        return schema.selectExpr("*", "CAST(NULL AS BIGINT) AS only_left", "CAST(NULL AS BIGINT) AS only_right")

    def cells(df: DataFrame, sign: int) -> DataFrame:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        halves = [digest([(F.col(f"c{i}"), df.schema[f"c{i}"].dataType)]) for i in alike]
        each = F.array(*[F.struct(F.lit(i).alias("position"), x.alias(_D1), y.alias(_D2)) for i, (x, y) in zip(alike, halves)])
        return df.select(F.inline(each)).withColumn(_W, F.lit(sign))

    signed = (cells(a, LEFT).unionByName(cells(b, RIGHT)).groupBy("position", _D1, _D2).agg(F.sum(_W).alias("_d"))
              .groupBy("position").agg(_only(LEFT).alias("only_left"), _only(RIGHT).alias("only_right")))
    found = schema.join(F.broadcast(signed), "position", "left")     # a row a column
    zero = F.when(F.col("same_type"), F.lit(0))                      # two tables without rows
    return found.select("position", "left_column", "right_column", "same_name", "same_type",
                        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("only_left", "only_right")])


def compare_tables(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """``check, result, differences`` for ``columns``, ``types``, ``contents``.

    ``result`` is ``identical`` only when every value agrees (not only the
    first distinct comparison result).
    """
    n_names = names_differences(a.schema, b.schema)
    n_types = types_differences(a.schema, b.schema)
    schema_rows = spark.createDataFrame(
        [("columns", n_names), ("types", n_types)], "check string, differences bigint")
    if n_names == 0 and n_types == 0:
        diff = content_differences(a, b)
        contents = diff.select(F.lit("contents").alias("check"),
                               (F.col("only_left") + F.col("only_right")).alias("differences"))
    else:
        # Columns do not line up: contents cannot be compared row by row.
        contents = spark.createDataFrame([("contents", None)], "check string, differences bigint")
    rows = schema_rows.unionByName(contents)
    return rows.select("check", verdict(F.coalesce(F.col("differences") == 0, F.lit(False))).alias("result"),
                       "differences")


def roundtrip_check(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet",
                    options: dict | None = None) -> DataFrame:
    """Write ``df`` to ``path`` in ``fmt``, read it back and compare.

    For text formats the original schema is used to read back (types are
    never re-inferred); CSV goes through the lossless form of
    :func:`driftwise.sources.files.write_csv`.  The write happens now; the
    comparison is lazy.
    """
    options = dict(options or {})
    if fmt == "csv":
        header = str(options.pop("header", "true")).lower() == "true"
        write_csv(df, path, header=header, **options)
        return compare_tables(spark, df, read_exact_csv(spark, path, df.schema, header=header, **options))
    if fmt == "json":
        # JSON, like CSV, keeps only milliseconds of a timestamp by default
        options = {**CSV_TIME_OPTIONS, **options}
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("json", "text"):
        reader = reader.schema(df.schema)
    back = reader.load(path)
    return compare_tables(spark, df, back)
