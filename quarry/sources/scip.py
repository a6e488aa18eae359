"""Index files of code navigation (SCIP, a protocol-buffer format) as documents, and documents as index files.

A file is one message whose fields are metadata, documents and external symbols.  Reading takes two jobs: one task
a file walks the headers of its fields and emits where each document lies, and documents are then read and decoded
wherever Spark puts them.  A file that ends within a field is an error that names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage

DIAGNOSTIC = "struct<severity:int,code:string,message:string>"
OCCURRENCE = (
    f"struct<symbol:string,start_line:int,start_col:int,end_line:int,end_col:int,roles:int,docs:array<string>,diagnostics:array<{DIAGNOSTIC}>>"
)
SYMBOL = "struct<symbol:string,docs:array<string>,display_name:string>"
DOCUMENT = f"path string, language string, occurrences array<{OCCURRENCE}>, symbols array<{SYMBOL}>"

_DIAGNOSTIC = pa.struct([("severity", pa.int32()), ("code", pa.string()), ("message", pa.string())])
_OCCURRENCE = pa.struct(
    [("symbol", pa.string()), *((k, pa.int32()) for k in ("start_line", "start_col", "end_line", "end_col", "roles")),
     ("docs", pa.list_(pa.string())), ("diagnostics", pa.list_(_DIAGNOSTIC))]
)
OCCURRENCE_FIELDS = tuple(f.name for f in _OCCURRENCE)
_SYMBOL = pa.struct([("symbol", pa.string()), ("docs", pa.list_(pa.string())), ("display_name", pa.string())])
_DOCUMENT = pa.schema([("path", pa.string()), ("language", pa.string()), ("occurrences", pa.list_(_OCCURRENCE)), ("symbols", pa.list_(_SYMBOL))])

# Field numbers of the format's messages.
INDEX_DOCUMENT, INDEX_EXTERNAL = 2, 3
DOC_PATH, DOC_OCCURRENCES, DOC_SYMBOLS, DOC_LANGUAGE = 1, 2, 3, 4
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_DOCS, OCC_DIAGNOSTICS = 1, 2, 3, 4, 6
SYM_SYMBOL, SYM_DOCS, SYM_DISPLAY = 1, 3, 6
DIAG_SEVERITY, DIAG_CODE, DIAG_MESSAGE = 1, 2, 3

#: Bytes of a file that are looked at for headers at a time, and occurrences in a batch of decoded documents.
WINDOW, BATCH = 1 << 20, 10_000


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: a number, or the bytes of what has a length."""
    at, end = 0, len(data)
    while at < end:
        tag, at = data[at], at + 1
        if tag > 127:
            tag, at = _varint(data, at - 1)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = data[at], at + 1
                if size > 127:
                    size, at = _varint(data, at - 1)
            else:
                size = {1: 8, 5: 4}[kind]
            if at + size > end:
                raise IndexError("a field is longer than its message")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _text(value) -> str:
    return value.decode("utf-8", "replace")


def _occurrence(data) -> dict:
    span, out = [], {"symbol": "", "roles": 0, "docs": [], "diagnostics": []}
    for number, value in _fields(data):
        if number == OCC_RANGE:
            at = 0
            if isinstance(value, int):
                span.append(value)
                continue
            if value.isascii():  # every number has one byte
                span += value
                continue
            while at < len(value):
                x, at = _varint(value, at)
                span.append(x)
        elif number == OCC_SYMBOL:
            out["symbol"] = _text(value)
        elif number == OCC_ROLES:
            out["roles"] = value
        elif number == OCC_DOCS:
            out["docs"].append(_text(value))
        elif number == OCC_DIAGNOSTICS:
            d = dict(_fields(value))
            out["diagnostics"].append(
                {"severity": d.get(DIAG_SEVERITY, 0), "code": _text(d.get(DIAG_CODE, b"")), "message": _text(d.get(DIAG_MESSAGE, b""))}
            )
    if len(span) == 3:
        span.insert(2, span[0])
    out["start_line"], out["start_col"], out["end_line"], out["end_col"] = span if len(span) == 4 else (0, 0, 0, 0)
    return out


def _symbol(data) -> dict:
    out = {"symbol": "", "docs": [], "display_name": ""}
    for number, value in _fields(data):
        if number == SYM_DOCS:
            out["docs"].append(_text(value))
        elif number in (SYM_SYMBOL, SYM_DISPLAY):
            out["symbol" if number == SYM_SYMBOL else "display_name"] = _text(value)
    return out


def _document(data) -> dict:
    out = {"path": "", "language": "", "occurrences": [], "symbols": []}
    for number, value in _fields(data):
        if number == DOC_OCCURRENCES:
            out["occurrences"].append(_occurrence(value))
        elif number == DOC_SYMBOLS:
            out["symbols"].append(_symbol(value))
        elif number in (DOC_PATH, DOC_LANGUAGE):
            out["path" if number == DOC_PATH else "language"] = _text(value)
    return out


def _headers(path: str) -> Iterator[tuple[int, int, int]]:
    """(field, offset, size) of the documents and external symbols of a file; what they hold is not read."""
    fs, name = storage.file_system(path)
    with fs.open_input_file(name) as f:
        end, at, base, window = f.size(), 0, 0, b""
        while at < end:
            if at < base or at + 20 > base + len(window):
                base, window = at, f.read_at(min(WINDOW, end - at), at)
            tag, here = _varint(window, at - base)
            if tag & 7 == 0:
                _, here = _varint(window, here)
                size = 0
            else:
                size, here = _varint(window, here) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], here)
            at = base + here + size
            if at > end:
                raise IndexError("a field is longer than its file")
            if tag >> 3 in (INDEX_DOCUMENT, INDEX_EXTERNAL):
                yield tag >> 3, base + here, size


def _walk(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                found = list(_headers(path))
            except (IndexError, KeyError) as e:
                raise ValueError(f"{path} is no whole index file") from e
            for i in range(0, len(found), 10_000):
                field, offset, size = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(field)), pa.array(field, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())],
                    ["file", "field", "offset", "size"],
                )


def _decode(batches):
    for batch in batches:
        rows, held, name, f = [], 0, None, None
        for r in sorted(batch.to_pylist(), key=lambda r: (r["file"], r["offset"])):
            if r["file"] != name:
                name = r["file"]
                fs, path = storage.file_system(name)
                f = fs.open_input_file(path)
            data = f.read_at(r["size"], r["offset"])
            try:
                if r["field"] == INDEX_DOCUMENT:
                    rows.append(_document(data))
                else:
                    rows.append({"path": None, "language": None, "occurrences": [], "symbols": [_symbol(data)]})
            except (IndexError, KeyError) as e:
                raise ValueError(f"{name} is no whole index file") from e
            held += len(rows[-1]["occurrences"]) + len(rows[-1]["symbols"]) + 1
            if held >= BATCH:
                yield from pa.Table.from_pylist(rows, _DOCUMENT).to_batches()
                rows, held = [], 0
        if rows:
            yield from pa.Table.from_pylist(rows, _DOCUMENT).to_batches()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, language, occurrences, symbols): a row a document of all index files; external symbols have no path.

    An occurrence whose range has neither three nor four numbers lies at zero; unknown fields are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = files.mapInArrow(_walk, "file string, field int, offset long, size long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "file", F.floor(F.col("offset") / WINDOW)).mapInArrow(_decode, DOCUMENT)


def occurrences(documents: DataFrame) -> DataFrame:
    """A row an occurrence, with its file and its place in the document; ``definition`` is the first bit of the roles."""
    rows = documents.where("path is not null").select(F.col("path").alias("file"), F.posexplode("occurrences").alias("ordinal", "o"))
    return rows.select("file", "ordinal", "o.*", ((F.col("o.roles").bitwiseAND(1)) != 0).alias("definition"))


def symbols(documents: DataFrame) -> DataFrame:
    """(symbol, docs): what is known of each symbol once, with the documentation of the first file that has one."""
    rows = documents.select(F.coalesce("path", F.lit("")).alias("p"), F.explode("symbols").alias("s")).select("p", "s.symbol", "s.docs")
    has = F.size("docs") > 0
    return rows.groupBy("symbol").agg(F.min_by(F.when(has, F.col("docs")), F.when(has, F.struct("p", "docs"))).alias("docs"))


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _put(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value) if value else b""
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def _span(start_line: int, start_col: int, end_line: int, end_col: int) -> bytes:
    span = (start_line, start_col, end_col) if end_line == start_line else (start_line, start_col, end_line, end_col)
    if 0 <= min(span) and max(span) < 128:
        return bytes((OCC_RANGE << 3 | 2, len(span), *span))
    return _put(OCC_RANGE, b"".join(map(_number, span)))


def encode(document: dict) -> bytes:
    """The field of an index that holds a document, or, without a path, its symbols as external ones.

    Occurrences are tuples of their fields' values, in order; symbols and roles that come again are encoded once.
    """
    known = [
        _put(SYM_SYMBOL, s["symbol"]) + b"".join(_put(SYM_DOCS, x) for x in s["docs"] or ()) + _put(SYM_DISPLAY, s["display_name"] or "")
        for s in document["symbols"] or ()
    ]
    if document["path"] is None:
        return b"".join(_put(INDEX_EXTERNAL, x) for x in known)
    out = [_put(DOC_PATH, document["path"]), _put(DOC_LANGUAGE, document["language"] or "")]
    seen: dict[tuple[str, int], bytes] = {}
    for symbol, start_line, start_col, end_line, end_col, roles, docs, diagnostics in document["occurrences"] or ():
        named = seen.get((symbol, roles))
        if named is None:
            named = seen[symbol, roles] = _put(OCC_SYMBOL, symbol) + _put(OCC_ROLES, roles)
        body = _span(start_line, start_col, end_line, end_col) + named
        if docs:
            body += b"".join(_put(OCC_DOCS, x) for x in docs)
        for x in diagnostics:
            body += _put(OCC_DIAGNOSTICS, _put(DIAG_SEVERITY, x["severity"]) + _put(DIAG_CODE, x["code"]) + _put(DIAG_MESSAGE, x["message"]))
        out.append(_put(DOC_OCCURRENCES, body))
    return _put(INDEX_DOCUMENT, b"".join([*out, *(_put(DOC_SYMBOLS, x) for x in known)]))


def _values(column: pa.Array) -> list:
    """The values of a column of numbers or strings."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    coded = column.dictionary_encode()
    return list(map(coded.dictionary.to_pylist().__getitem__, _values(coded.indices)))


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column; empty ones cost nothing."""
    values, at = column.flatten().to_pylist(), 0
    for n in _values(pc.fill_null(pc.list_value_length(column), 0)):
        yield values[at : at + n] if n else ()
        at += n


def _plain(row: pa.RecordBatch) -> dict:
    """A batch of one document as ``encode`` takes it: its occurrences by columns, as objects for all values take many times as long."""
    found = row.column(2).flatten()
    fields = {f.name: c for f, c in zip(found.type, found.flatten(), strict=True)}
    columns = [_lists(fields[name]) if name in ("docs", "diagnostics") else _values(fields[name]) for name in OCCURRENCE_FIELDS]
    path, language, symbols = (row.column(i).to_pylist()[0] for i in (0, 1, 3))
    return {"path": path, "language": language, "occurrences": zip(*columns, strict=True), "symbols": symbols}


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, name = storage.file_system(folder)
        fs.create_dir(name, recursive=True)
        # a task that is run again writes the same file over
        with fs.open_output_stream(f"{name}/part-{task.partitionId():05}.scip") as f:
            n = 0
            for batch in batches:
                # a document may be large: a batch of them is never all Python objects at once
                for i in range(batch.num_rows):
                    n += 1
                    f.write(encode(_plain(batch.slice(i, 1))))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def write(documents: DataFrame, folder: str) -> int:
    """Writes documents as index files under a new folder, one a task; the number of documents."""
    spark = documents.sparkSession
    rows = documents.select("path", "language", "occurrences", "symbols").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return rows.mapInArrow(_writer(folder), "n long").agg(F.sum("n")).first()[0]
