"""Split-oriented JSON tables: ``{"columns": [...], "index": [...],
"data": [[row], ...]}``.

Reading: documents are parsed with an explicit schema (cells as text),
``posexplode`` turns every document into its rows (the document's index,
or the row position when it has none), and every
output column is looked up by name in the document's own ``columns`` list
and converted with ``try_cast``.  Documents may be one per file
(``multi_line=True``, one task per file) or one per line (splittable, the
form :func:`write_split_json` produces).  A single document too large for a
task is read by :func:`driftwise.sources.split_document.read_split_document`.

Writing: neighbouring rows of a partition become documents of at most
``rows_per_doc`` rows, one a line.  Rows are turned into JSON text by Spark's own
functions and grouped where they lie, a batch after the other, so nothing is
shuffled; with ``rows_per_doc=1`` each row is a document without any grouping.
A document leaves its task piece by piece, its index last, so a task holds a few
pieces however large the document is; only :func:`split_documents`, which returns a
document as one value, holds it whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.sqltext import col
from driftwise.session import workers_find_package

DOC_SCHEMA = "columns array<string>, index array<bigint>, data array<array<string>>"
PIECE_ROWS = 256        # rows, or 16 times as many index entries, that are text at a time
PIECE_CHARS = 1 << 20   # characters that leave a task at a time


def _typed(cell, dtype: T.DataType):
    """Text cell -> ``dtype``; null when it does not convert.  Integral
    targets also accept integral numbers written with a fraction ("1.0"), as
    JSON writers emit for integer columns that hold nulls."""
    if isinstance(dtype, T.IntegralType):
        d = cell.try_cast("double")
        return F.coalesce(cell.try_cast(dtype), F.when(d == F.floor(d), d.try_cast(dtype)))
    return cell.try_cast(dtype)


def typed_cell(cell: Column, field: T.StructField, bad_cells: str) -> Column:
    """A text cell as the field's type; one that does not convert raises, or is null."""
    if bad_cells not in ("raise", "null"):
        raise ValueError("bad_cells is 'raise' or 'null'")
    value = _typed(cell, field.dataType)
    if bad_cells == "null":
        return value
    said = F.concat(F.lit(f"column {field.name}: not a {field.dataType.simpleString()}: "), cell)
    return F.when(cell.isNotNull() & value.isNull(), F.raise_error(said).cast(field.dataType)).otherwise(value)


def read_split_json(spark: SparkSession, path: str, schema: T.StructType | str,
                    multi_line: bool = False, index_col: str | None = "index",
                    bad_cells: str = "raise") -> DataFrame:
    """Rows of all split documents under ``path``, typed by ``schema``.

    A malformed document raises, and so does a cell that does not convert
    (``bad_cells="null"``: it becomes null).
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    docs = spark.read.schema(DOC_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    rows = docs.select("columns", "index", F.posexplode("data").alias("pos", "row"))
    cols = []
    if index_col:
        # the document's own index, or the row position when it has none
        index = F.coalesce(F.try_element_at(F.col("index"), (F.col("pos") + 1).cast("int")),
                           F.col("pos").cast("bigint"))
        cols.append(index.alias(index_col))
    for f in schema.fields:
        pos = F.array_position(F.col("columns"), F.lit(f.name)).cast("int")
        cols.append(typed_cell(F.try_element_at(F.col("row"), pos), f, bad_cells).alias(f.name))
    return rows.select(*cols)


def _grouped(batches: Iterator[pa.RecordBatch], header: str, rows_per_doc: int) -> Iterator[pa.RecordBatch]:
    """Documents from a partition's rows, in their order; a document may span batches."""
    ids: list[str] = []
    rows: list[str] = []

    def document() -> str:
        return f'{{"columns":{header},"index":[{",".join(ids)}],"data":[{",".join(rows)}]}}'

    for batch in batches:
        out, at, new_ids, new_rows = [], 0, [str(i) for i in batch["_i"].to_pylist()], batch["_row"].to_pylist()
        while at < len(new_rows):
            take = min(len(new_rows) - at, rows_per_doc - len(rows))
            ids += new_ids[at:at + take]
            rows += new_rows[at:at + take]
            at += take
            if len(rows) == rows_per_doc:
                out.append(document())
                ids, rows = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([document()], pa.string())], names=["value"])


def _pieces(batches: Iterator[pa.RecordBatch], header: str, rows_per_doc: int) -> Iterator[str]:
    """The documents of :func:`_grouped` as pieces of text, cut between two rows or entries:
    a line break before every document but the first, and the index, whose entries
    are consecutive in a partition, behind the rows."""
    first = n = 0
    begin = ""

    def index() -> Iterator[str]:
        yield '],"index":['
        for a in range(0, n, 16 * PIECE_ROWS):
            yield ("," if a else "") + ",".join(map(str, range(first + a, first + min(a + 16 * PIECE_ROWS, n))))
        yield "]}"

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, rows_per_doc - n, PIECE_ROWS)
            if not n:
                first = batch["_i"][at].as_py()
                yield f'{begin}{{"columns":{header},"data":['
                begin = "\n"
            yield ("," if n else "") + ",".join(batch["_row"].slice(at, take).to_pylist())
            at += take
            n += take
            if n == rows_per_doc:
                yield from index()
                n = 0
    if n:
        yield from index()


def _written(batches: Iterator[pa.RecordBatch], header: str, rows_per_doc: int) -> Iterator[pa.RecordBatch]:
    """The pieces, put together up to ``PIECE_CHARS`` characters."""
    held: list[str] = []
    chars = 0
    for piece in _pieces(batches, header, rows_per_doc):
        held.append(piece)
        chars += len(piece)
        if chars >= PIECE_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string())], names=["value"])
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string())], names=["value"])


def _lined(df: DataFrame) -> DataFrame:
    """Rows as JSON text with their index entries."""
    workers_find_package(df.sparkSession)
    cells = F.array(*[col(c).cast("string") for c in df.columns])
    return df.select(F.monotonically_increasing_id().alias("_i"), F.to_json(cells).alias("_row"))


def split_documents(df: DataFrame, rows_per_doc: int = 1000) -> DataFrame:
    """``df`` as split documents: one column ``value``, one JSON document a row.

    A document holds up to ``rows_per_doc`` neighbouring rows of one partition; its
    index holds integers that rise within a partition and are unique over all.
    """
    if rows_per_doc < 1:
        raise ValueError("rows_per_doc must be at least 1")
    names = df.columns
    if rows_per_doc == 1:
        header = F.array(*[F.lit(c) for c in names]).alias("columns")
        idx = F.monotonically_increasing_id()
        cells = F.array(*[col(c).cast("string") for c in names])
        return df.select(F.to_json(F.struct(header, F.array(idx).alias("index"), F.array(cells).alias("data"))).alias("value"))
    header = json.dumps(names, ensure_ascii=False)
    return _lined(df).mapInArrow(lambda batches: _grouped(batches, header, rows_per_doc), "value string")


def write_split_json(df: DataFrame, path: str, rows_per_doc: int = 1000,
                     mode: str = "overwrite") -> None:
    """Write ``df`` as split documents, one a line.  No row leaves its partition; a
    task holds a piece of a document at a time, and the pieces of a line are parted
    by blanks, which JSON allows there."""
    if rows_per_doc <= 1:
        split_documents(df, rows_per_doc).write.mode(mode).text(path)
        return
    header = json.dumps(df.columns, ensure_ascii=False)
    pieces = _lined(df).mapInArrow(lambda batches: _written(batches, header, rows_per_doc), "value string")
    pieces.write.mode(mode).option("lineSep", " ").text(path)
