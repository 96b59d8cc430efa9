"""One huge split-oriented JSON document, read by many tasks.

A document ``{"columns": [...], "index": [...], "data": [[row], ...]}`` is one line
and one JSON value, so a text or JSON scan gives it to one task whatever its size.
Here its file is cut into byte ranges, and a range is re-synchronised exactly:

1. each range counts its quotes (a quote behind an odd number of backslashes is text)
   and its brackets, once as if it began outside a string and once inside; adding these
   up in order says for every range whether it begins inside a string, and how deep;
2. each range reports where the document's sections open and close, how many rows it
   opens and how many index entries begin in it: sums over the ranges before give each
   range the number of its first row;
3. each range parses the rows that open in it, reading on past its end for the last
   one, and fetches just those rows' index entries.

Only steps 1 and 2 meet on the driver, as a few numbers a range; all bytes are read
in tasks.  The file system must be one that the workers can open by the path's URI.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.session import workers_find_package
from driftwise.sources.split_json import typed_cell

RANGE_BYTES = 16 << 20
BATCH_ROWS = 4096
LOOK_BACK = 256         # bytes before a section in which its key is looked for

_OPEN = np.zeros(256, np.int8)
_OPEN[[0x5B, 0x7B]] = 1
_OPEN[[0x5D, 0x7D]] = -1
_MARK = _OPEN != 0
_MARK[0x2C] = True


def _store(uri: str) -> tuple[FileSystem, str]:
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[len("file:"):]
    return FileSystem.from_uri(uri)


def _files(uri: str) -> list[tuple[str, int]]:
    """Data files at ``uri`` (a file, or a folder without hidden entries) and their sizes."""
    store, path = _store(uri)
    at = store.get_file_info(path)
    if at.type == FileType.File:
        return [(uri, at.size)]
    if at.type == FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f for f in store.get_file_info(FileSelector(path)) if f.is_file and f.base_name[0] not in "._" and f.size]
    return sorted((f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in found)


def _bytes(store: FileSystem, path: str, start: int, end: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(max(0, end - start), start)


def _backslashes_before(store: FileSystem, path: str, start: int) -> int:
    """How many backslashes stand right before ``start``."""
    reach = 64
    while True:
        text = _bytes(store, path, max(0, start - reach), start)
        n = len(text) - len(text.rstrip(b"\\"))
        if n < len(text) or len(text) == start:
            return n
        reach *= 8


def _quotes(buf: np.ndarray, pending: int) -> np.ndarray:
    """Places of the quotes that begin or end a string; ``pending`` backslashes stand before the buffer."""
    quotes = np.flatnonzero(buf == 0x22)
    slashes = np.flatnonzero(buf == 0x5C)
    if not len(quotes) or not (len(slashes) or pending):
        return quotes
    head = np.ones(len(slashes), dtype=bool)
    head[1:] = np.diff(slashes) != 1
    first = np.maximum.accumulate(np.where(head, np.arange(len(slashes)), 0))
    run = np.arange(len(slashes)) - first + 1        # backslashes up to each one
    run += np.where(slashes[first] == 0, pending, 0) if len(slashes) else 0
    before = np.searchsorted(slashes, quotes) - 1
    behind = (before >= 0) & (slashes[before] == quotes - 1) if len(slashes) else np.zeros(len(quotes), dtype=bool)
    odd = np.zeros(len(quotes), dtype=bool)
    odd[behind] = run[before[behind]] % 2 == 1
    odd |= (quotes == 0) & (pending % 2 == 1)
    return quotes[~odd]


def _marks(buf: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Places of brackets and commas outside strings."""
    marks = np.flatnonzero(_MARK[buf])
    return marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: parity of the quotes, and the change of depth if the range begins outside or inside a string."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            store, path = _store(r["uri"])
            buf = np.frombuffer(_bytes(store, path, r["start"], r["stop"]), np.uint8)
            quotes = _quotes(buf, _backslashes_before(store, path, r["start"]))
            deeper = [int(_OPEN[buf[_marks(buf, quotes, inside)]].sum(dtype=np.int64)) for inside in (False, True)]
            out.append((r["file"], r["n"], len(quotes) % 2, *deeper))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["file", "n", "odd", "outside", "inside"])


@dataclass
class _State:
    """What is known of a byte range once the ones before it were added up."""

    buf: np.ndarray
    start: int
    marks: np.ndarray
    before: np.ndarray      # depth before each mark
    after: np.ndarray

    @classmethod
    def read(cls, store: FileSystem, path: str, start: int, stop: int, inside: bool, depth: int) -> _State:
        buf = np.frombuffer(_bytes(store, path, start, stop), np.uint8)
        marks = _marks(buf, _quotes(buf, _backslashes_before(store, path, start)), inside)
        change = _OPEN[buf[marks]].astype(np.int64)
        after = depth + np.cumsum(change)
        return cls(buf, start, marks, after - change, after)

    def steps(self, before: int, after: int) -> np.ndarray:
        """Marks at which the depth goes from one value to another (equal: a comma)."""
        return self.marks[(self.before == before) & (self.after == after)]


def _sectioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: one row per range and section event: where, what opens (1) or closes (-1; 0: the range's
    end), and the rows opened and commas passed since the event before."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            store, path = _store(r["uri"])
            s = _State.read(store, path, r["start"], r["stop"], r["inside"], r["depth"])
            events = sorted([(int(p), 1) for p in s.steps(1, 2)] + [(int(p), -1) for p in s.steps(2, 1)] + [(len(s.buf), 0)])
            rows, commas, last = s.steps(2, 3), s.steps(2, 2), -1
            for k, (p, kind) in enumerate(events):
                out.append((r["file"], r["n"], k, s.start + p, kind, int(((rows > last) & (rows < p)).sum()), int(((commas > last) & (commas < p)).sum())))
                last = p
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["file", "n", "k", "at", "kind", "rows", "commas"])


@dataclass
class _Document:
    """Sections of one file: places of the brackets, and what each range has before it."""

    uri: str
    places: dict[str, tuple[int, int]] = field(default_factory=dict)
    row0: list[int] = field(default_factory=list)       # rows opened before each range
    rows: list[int] = field(default_factory=list)
    item0: list[int] = field(default_factory=list)      # index entries begun before each range


def _key(uri: str, at: int) -> str:
    """Name of the section whose bracket is at ``at``."""
    store, path = _store(uri)
    before = _bytes(store, path, max(0, at - LOOK_BACK), at)
    found = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', before, re.DOTALL)
    return json.loads(b'"' + found[1] + b'"') if found else ""


def _assembled(uri: str, events: list, ranges: int) -> _Document:
    doc, now, opened = _Document(uri), "", 0
    n_rows = n_items = 0
    last = -1
    for e in events:
        if e["n"] != last:
            doc.row0.append(n_rows)
            doc.item0.append(n_items)
            last = e["n"]
        if now == "data":
            n_rows += e["rows"]
        elif now == "index":
            n_items += e["commas"]
        if e["kind"] == 1:
            now, opened = _key(uri, e["at"]), e["at"]
            if now in doc.places:
                raise ValueError(f"{uri}: more than one document, or two sections {now!r}")
            n_items += now == "index"
        elif e["kind"] == -1:
            doc.places[now] = (opened, e["at"])
            now = ""
    if now or not {"columns", "data"} <= set(doc.places):
        raise ValueError(f"{uri}: MALFORMED split document (sections {sorted(doc.places)})")
    doc.rows = [b - a for a, b in zip(doc.row0, [*doc.row0[1:], n_rows])]
    assert len(doc.row0) == ranges
    return doc


def _cell(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)        # a boolean, or something nested


def _parse(text: bytes) -> list:
    """A JSON array; numbers stay as they are written."""
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=str)


def _entries(r: dict, store: FileSystem, path: str, n: int) -> list[int]:
    """Index entries ``row0 .. row0 + n`` of a document."""
    opened, closed = r["index_open"], r["index_close"]
    start, inside, number = r["index_start"], r["index_inside"], r["index_item0"]
    first, depth, step = None, r["index_depth"], r["step"]
    while start <= closed:
        s = _State.read(store, path, start, start + step, inside, depth)
        begins = start + np.concatenate([s.steps(1, 2), s.steps(2, 2)]) + 1
        begins = np.sort(begins[(begins > opened) & (begins <= closed)])
        if first is None and number + len(begins) > r["row0"]:
            first = int(begins[r["row0"] - number])
        if number + len(begins) > r["row0"] + n:
            return [int(x) for x in _parse(b"[" + _bytes(store, path, first, int(begins[r["row0"] + n - number]) - 1) + b"]")]
        number += len(begins)
        quotes = _quotes(s.buf, _backslashes_before(store, path, start))
        inside, depth = (len(quotes) + inside) % 2 == 1, depth + int(_OPEN[s.buf[s.marks]].sum(dtype=np.int64))
        start += step
    found = [] if first is None else [int(x) for x in _parse(b"[" + _bytes(store, path, first, closed) + b"]")]
    if len(found) != n:
        raise ValueError(f"{r['uri']}: MALFORMED split document (fewer index entries than rows)")
    return found


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Step 3: the rows that open in a range, cells as text."""
    for batch in batches:
        for r in batch.to_pylist():
            store, path = _store(r["uri"])
            labels = json.loads(r["columns"])
            place = [labels.index(n) if n in labels else None for n in names]
            stop, extra = r["stop"], 1 << 16
            while True:
                s = _State.read(store, path, r["start"], stop, r["inside"], r["depth"])
                opens, closes = s.steps(2, 3), s.steps(3, 2)
                own = (opens > r["data_open"] - s.start) & (opens < min(r["stop"], r["data_close"]) - s.start)
                opens = opens[own]
                closes = closes[np.searchsorted(closes, opens[0]):] if len(opens) else closes
                if len(closes) >= len(opens):
                    break
                if stop >= r["data_close"]:
                    raise ValueError(f"{r['uri']}: MALFORMED split document (a row has no end)")
                stop, extra = min(stop + extra, r["data_close"] + 1), extra * 4
            index = _entries(r, store, path, len(opens)) if r["index_open"] is not None else range(r["row0"], r["row0"] + len(opens))
            data = s.buf.tobytes()
            for a in range(0, len(opens), BATCH_ROWS):
                b = min(a + BATCH_ROWS, len(opens))
                cells = _parse(b"[" + data[opens[a]:closes[b - 1] + 1] + b"]")
                cols = [[None if p is None or p >= len(x) else _cell(x[p]) for x in cells] for p in place]
                yield pa.RecordBatch.from_arrays([pa.array(index[a:b], pa.int64()), *[pa.array(c, pa.string()) for c in cols]],
                                                 names=["_index", *[f"c{i}" for i in range(len(names))]])


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row a task, as far as the cluster has tasks to give."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


RANGE = "file long, n long, uri string, start long, stop long, inside boolean, depth long"
DATA_RANGE = ("uri string, start long, stop long, inside boolean, depth long, row0 long, columns string, data_open long, data_close long, "
              "index_open long, index_close long, index_start long, index_inside boolean, index_depth long, index_item0 long, step long")


def _survey(spark: SparkSession, uri: str, step: int) -> list[tuple]:
    """Steps 1 and 2 on all files: the rows of ``DATA_RANGE``."""
    files = _files(uri)
    cut = [(k, n, f, a, min(a + step, size)) for k, (f, size) in enumerate(files) for n, a in enumerate(range(0, size, step))]
    if not cut:
        return []
    first = _table(spark, [(*c, False, 0) for c in cut], RANGE).mapInArrow(_surveyed, "file long, n long, odd long, outside long, inside long")
    seen = {(r.file, r.n): r for r in first.collect()}      # a few numbers a range
    states = {}
    for k in range(len(files)):     # every file in order of its ranges
        inside, depth = False, 0
        for n in range(-(-files[k][1] // step)):
            states[k, n] = (inside, depth)
            s = seen[k, n]
            depth += s.inside if inside else s.outside
            inside ^= s.odd == 1
        if inside or depth:
            raise ValueError(f"{files[k][0]}: MALFORMED split document (it does not end where it should)")
    second = _table(spark, [(*c, *states[c[0], c[1]]) for c in cut], RANGE).mapInArrow(
        _sectioned, "file long, n long, k long, at long, kind long, rows long, commas long")
    by_file = {k: list(found) for k, found in groupby(sorted(second.collect(), key=lambda e: (e.file, e.n, e.k)), key=lambda e: e.file)}
    out = []
    for k, (f, size) in enumerate(files):
        ranges = -(-size // step)
        doc = _assembled(f, by_file[k], ranges)
        store, path = _store(f)
        a, b = doc.places["columns"]
        labels = json.dumps([x if isinstance(x, str) else json.dumps(x) for x in json.loads(_bytes(store, path, a, b + 1))])
        index = doc.places.get("index")
        for n in range(ranges):
            if not doc.rows[n]:
                continue
            inside, depth = states[k, n]
            at = (None,) * 6
            if index:
                q = max(index[0] // step, int(np.searchsorted(doc.item0, doc.row0[n], "right")) - 1)
                at = (*index, q * step, *states[k, q], doc.item0[q])
            out.append((f, n * step, min((n + 1) * step, size), inside, depth, doc.row0[n], labels, *doc.places["data"], *at, step))
    return out


def read_split_document(spark: SparkSession, path: str, schema: T.StructType | str, index_col: str | None = "index",
                        bad_cells: str = "raise", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of the split document in the file ``path`` (or of one document a file, in a
    folder), typed by ``schema``: as :func:`read_split_json` with ``multi_line``, but a
    file is read by as many tasks as it has ranges.  The sections may stand in any
    order; without an index its entries are the rows' numbers.  A malformed document
    and a cell that does not convert raise (``bad_cells="null"``: null)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    workers_find_package(spark)
    names = schema.names
    types = ", ".join(["_index long", *[f"c{i} string" for i in range(len(names))]])
    found = _table(spark, _survey(spark, path, range_bytes), DATA_RANGE).mapInArrow(lambda b: _rows(b, names), types)
    out: list[Column] = [F.col("_index").alias(index_col)] if index_col else []
    out += [typed_cell(F.col(f"c{i}"), f, bad_cells).alias(f.name) for i, f in enumerate(schema.fields)]
    return found.select(*out)
