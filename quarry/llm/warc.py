"""WARC archives: writing them, and reading them back by boundary-chain verification.

Writing is a DataFrame of record texts that the text sink stores with the record end as line separator.
Payloads of at least ``MIN_REVISIT`` bytes that are equal (SHA-1 and length) are stored once, by the
record with the largest page_id; the others become revisits that refer to it.

Reading splits each file into chunks.  Every chunk's task looks for the magic at any offset, in payloads
too, reads the header there and emits the offset with that of its successor, carried on within the chunk
to the first offset beyond it.  A pointer that starts at a file's first byte is then doubled over these
offsets: only what it reaches is a record, so that a whole fake record inside a payload is never taken
for one, and a file whose chain does not reach its end is an error.  Each chunk that the chain enters is
read again from that entry, as a stream.  Headers, which hold the url, may have any length.

Archives of others are read as well, version 1.0 or 1.1, not compressed: record ids that are no page numbers are
null, records of other types come back with their type and their whole block as payload, digests may be base 32, and
a revisit that does not say how long its payload was has no length.

Defined cases: a null html is an empty payload; payloads and urls may have any length; a null url leaves its header out and line breaks in one
are percent-encoded; a null page_id leaves its number out and is read back as null; rows that repeat the
largest page_id of equal payloads are all responses; an empty table makes archives without records;
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import new_folder, shared_dir, written

#: Starts a record; a digit and a line break follow.
MAGIC = b"WARC/1."
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
CHUNK = 8 << 20
#: What is read for a header at first; the window doubles until the header ends.
HEADER = 64 << 10
#: What is read ahead at least, so that a chunk is read as a stream.
AHEAD = 1 << 20
#: Says that the data end before the header does.
MORE = "more"
#: Equal payloads up to this number are sent to every task (about 60 bytes each); beyond, rows are shuffled.
MAX_BROADCAST = 100_000


def record_texts(pages: DataFrame) -> DataFrame:
    """One ``value`` per page: a whole record without its end."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    same = written(
        p.where(F.col("size") >= MIN_REVISIT)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-equal",
    )
    if same.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        same = F.broadcast(same)
    p = p.join(same, ["digest", "size"], "left")
    again = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def opt(name, value):
        return F.coalesce(line(name, value), F.lit(""))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    return p.select(
        F.concat(
            F.lit(VERSION),
            line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn(F.col("page_id"))),
            line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
            opt("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(
                again,
                F.concat(
                    line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    line("WARC-Refers-To", urn(F.col("keeper"))),
                ),
            ).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write(pages: DataFrame, folder: str) -> None:
    record_texts(pages).write.option("lineSep", END).text(folder)


def open_file(path: str):
    """A file of the shared storage, for reads at any offset."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(url.path))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int] | str | None:
    """The header that starts at an offset, and the offset of its block; None if there is none, or MORE."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    header = {}
    at += len(VERSION)
    if len(data) < at:
        return MORE
    if not data[at - 3 : at - 2].isdigit() or data[at - 2 : at] != b"\r\n":
        return None
    while (stop := data.find(b"\r\n", at)) != at:
        if stop < 0:
            return MORE
        name, colon, value = data[at:stop].partition(b":")
        if not colon:
            return None
        header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = stop + 2
    if not header.get("content-length", "").isdigit():
        return None
    return header, at + 2


def candidates(data: bytes, base: int, stop: int, length: int) -> list[tuple[int, int]] | str:
    """(offset, first offset at or beyond ``stop`` that its chain reaches) in file offsets.

    ``data`` starts at ``base`` and goes on beyond ``stop`` by a header; MORE if that is too little for one.
    A chain that leaves the file or meets no magic is dropped; one that ends with the file has its length.
    """
    nxt: dict[int, int] = {}
    i = data.find(MAGIC)
    while i >= 0 and base + i < stop:
        head = parse_header(data, i)
        if head == MORE and base + len(data) < length:
            return MORE
        if head and head != MORE:
            to = base + head[1] + int(head[0]["content-length"]) + len(END)
            if to <= length:
                nxt[base + i] = to
        i = data.find(MAGIC, i + 1)
    out: dict[int, int] = {}
    for off in sorted(nxt, reverse=True):
        to = nxt[off]
        if to >= stop:
            out[off] = to
        elif to in out:
            out[off] = out[to]
    return sorted(out.items())


def _scan(frames):
    for frame in frames:
        for path, start, stop, length in frame.itertuples(index=False):
            with open_file(path) as f:
                window, pairs = HEADER, MORE
                while pairs == MORE:
                    data = f.read_at(min(stop + window, length) - start, start)
                    pairs = candidates(data, start, stop, length)
                    window *= 2
            yield pd.DataFrame({"path": path, "off": [a for a, _ in pairs], "to": [b for _, b in pairs]}).astype(
                {"path": object, "off": "int64", "to": "int64"}
            )


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    return files.select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(CHUNK).cast("long"))).alias("start"),
    ).select("path", "start", F.least(F.col("start") + CHUNK, F.col("length")).alias("stop"), "length")


def entries(chunks: DataFrame) -> DataFrame:
    """(path, entry): the first record of the file's chain in each chunk that has one."""
    n = max(1, min(chunks.count(), 100_000))
    jumps = written(
        chunks.repartition(n).mapInPandas(_scan, "path string, off long, to long"), "warc-candidates"
    )
    reached = chunks.select("path", F.lit(0).cast("long").alias("off")).distinct().join(jumps.select("path", "off"), ["path", "off"]).checkpoint()
    jumps = jumps.checkpoint()
    for _ in range(64):
        step = reached.join(jumps, ["path", "off"]).select("path", F.col("to").alias("off"))
        more = reached.unionAll(step).distinct().checkpoint()
        if more.count() == reached.count():
            break
        reached = more
        ahead = jumps.select("path", F.col("off").alias("to"), F.col("to").alias("far"))
        jumps = jumps.join(ahead, ["path", "to"]).select("path", "off", F.col("far").alias("to")).checkpoint()
    ends = chunks.select("path", F.col("length").alias("off")).distinct()
    if broken := ends.join(reached, ["path", "off"], "left_anti").first():
        raise ValueError(f"the records of {broken.path} do not lead to its end")
    return reached.select("path", F.col("off").alias("entry"))


class Stream:
    """A file read forward: every byte once, in reads of AHEAD bytes or more."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def need(self, at: int, n: int) -> int:
        """Has n bytes from ``at`` on, or all that the file has, in ``data``; returns the place of the first."""
        if not self.at <= at <= self.at + len(self.data):
            self.at, self.data = at, b""
        have = self.at + len(self.data) - at
        if have < min(n, self.size - at):
            more = self.file.read_at(min(max(n - have, AHEAD), self.size - at - have), at + have)
            self.at, self.data = at, self.data[at - self.at :] + more
        return at - self.at


#: The length of an HTTP body.
LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def page_number(record_id: str | None) -> int | None:
    """The number of a page's record; null for ids of others."""
    found = re.fullmatch(r"<urn:page:(\d+)>", record_id or "")
    return int(found[1]) if found else None


def hex_digest(told: str) -> str:
    """A SHA-1 in lower-case hex, from hex or base 32; empty for others."""
    value = told.strip().lower().removeprefix("sha1:")
    if re.fullmatch(r"[0-9a-f]{40}", value):
        return value
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[a-z2-7]{32}", value) else ""


def _records(with_payload: bool):
    def run(frames):
        for frame in frames:
            for path, entry, stop in frame.itertuples(index=False):
                rows, held = [], 0
                with open_file(path) as f:
                    at, stream = entry, Stream(f)
                    while at < stop:
                        window, found = HEADER // 16, MORE
                        while found == MORE and window < 2 * (HEADER + stream.size):
                            start = stream.need(at, window)
                            found = parse_header(stream.data, start)
                            window *= 2
                        if not found or found == MORE:
                            raise ValueError(f"no record in {path} at {at}")
                        header, block = found[0], found[1] - start
                        size = int(header["content-length"])
                        start = stream.need(at + block, size)
                        body = stream.data[start : start + size]
                        at += block + size + len(END)
                        kind = header.get("warc-type", "")
                        http = kind in ("response", "revisit") and body[:5] == b"HTTP/"
                        cut = body.find(b"\r\n\r\n") + 4 if http else 0
                        payload = body[cut:]
                        told = hex_digest(header.get("warc-payload-digest", ""))
                        if kind != "revisit":
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if kind == "response" and told and told != digest:
                                raise ValueError(f"payload digest differs in {path} at {at}")
                        else:
                            sizes = LENGTH.findall(body[:cut])
                            n, digest = int(sizes[-1]) if sizes else None, told
                        rows.append(
                            (
                                page_number(header.get("warc-record-id")),
                                header.get("warc-target-uri"),
                                kind,
                                page_number(header.get("warc-refers-to")),
                                n,
                                digest or None,
                                payload.decode("utf-8", "replace") if with_payload else None,
                            )
                        )
                        held += len(payload) * with_payload
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return run


_COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder."""
    shared_dir(spark)
    chunks = _chunks(spark, folder)
    first = entries(chunks).withColumn("start", F.col("entry") - F.col("entry") % CHUNK)
    work = chunks.join(first, ["path", "start"]).select("path", "entry", "stop").checkpoint()
    n = max(1, min(work.count(), 100_000))
    return work.repartition(n).mapInPandas(
        _records(with_payload),
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, payload string",
    )


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = new_folder(spark, "warc", keep=True)
    write(pages, folder)
    return read(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
    max(page_id) OVER (PARTITION BY sha1(h), strlen(h)) AS keeper
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
