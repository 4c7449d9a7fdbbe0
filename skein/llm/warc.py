"""WARC files: a writer with revisit records, and a reader that verifies the chain of record boundaries.

The writer makes each record one row of Spark's text writer, whose line separator is the end of a record, so files are put in
place by Spark's committer in any store. The reader lets Spark's text source split files at the magic "WARC/1.". Each magic is
a candidate: tasks emit its offset and that of its successor, which its Content-Length gives. Magic also occurs inside payloads;
only candidates that can be reached from their file's start are records. Reaching is pointer jumping: tasks first follow chains
within their own block, then exits of blocks are joined to entries of later blocks, twice as far in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import column, join_small, new_path, saved

MAGIC = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 100
_SKIP = len(MAGIC)


def _clean(text: F.Column) -> F.Column:
    """A header's value without the characters that would end it."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", " ")


def _line(name: str, value: F.Column) -> F.Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uuid(page_id: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes and response, the smallest page_id of an equal payload, where another page has it."""
    rows = pages.select(column(pages, "page_id", "long"), column(pages, "url", "string"), F.coalesce(pages["`html`"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html").cast("long")})
    large = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n"))
    again = saved(large.filter("n > 1").drop("n"), "payloads")
    return join_small(rows, again, ["digest"], "left").withColumn("response", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """A record for each row of pages: response, or revisit if a page with a smaller id has an equal payload of 100 bytes or more.

    The payload is the html in UTF-8, a null html an empty one. Rows that repeat the smallest page_id of a payload are responses
    too, and so are all rows of a payload that only pages without id have. Headers of null values are left out.
    """
    rows = planned(pages)
    again = F.col("response").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(again, _uuid(F.col("response"), F.col("digest")))),
        _line("X-Refers-To-Page", F.col("response").cast("string")),
        _line("X-Page", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block, F.lit("\r\n"))).write.option("lineSep", "\r\n").option("compression", "none").text(path)


def headers(data: bytes) -> dict[bytes, bytes]:
    """Lower-case names and values of header lines; the first of equal names counts."""
    out: dict[bytes, bytes] = {}
    for line in data.split(b"\r\n"):
        name, mark, value = line.partition(b":")
        if mark:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(value: bytes | None) -> int | None:
    return int(value) if value is not None and value.isdigit() else None


def _head(segment: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Of what follows a magic: where the block begins and its length, and the headers; None if this can be no record."""
    if segment[:3] not in (b"0\r\n", b"1\r\n") or (end := segment.find(b"\r\n\r\n")) < 0:
        return None
    found = headers(segment[3:end])
    length = _number(found.get(b"content-length"))
    return None if length is None else (end + 4, length, found)


def _record(found: dict[bytes, bytes], block: bytes) -> dict:
    """What the reader returns of a record."""
    kind = found.get(b"warc-type", b"").decode("utf-8", "replace")
    text = lambda name: found[name].decode("utf-8", "replace") if name in found else None
    length, payload, digest = None, block, None
    if found.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = _number(headers(head).get(b"content-length"))
    if kind == "revisit":
        digest = (text(b"warc-payload-digest") or "").removeprefix("sha256:") or None
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
    page, refers = text(b"x-page"), text(b"x-refers-to-page")
    return {"record_id": text(b"warc-record-id"), "record_type": kind, "url": text(b"warc-target-uri"), "page_id": int(page) if page else None, "payload_bytes": length, "payload_digest": digest, "refers_to": int(refers) if refers else None}


_RECORD = "record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, refers_to long"
_FIELDS = [x.split()[0] for x in _RECORD.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _frame(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))})


def _seed(spark: SparkSession, path: str) -> int:
    """A number with which no two files of a folder have the same hash. Only their names are read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("f"))
    seed, n = 0, files.count()
    while files.select(F.xxhash64(F.lit(seed), "f")).distinct().count() < n:
        seed += 1
    return seed


def _segments(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """file, block and data, in order in each partition: what lies between two magics, in the file's part that begins at block.

    file is the XXH64 of the seed and the path, so that rows stay small where they are joined.
    """
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.xxhash64(F.lit(seed), "_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for file, block, data in zip(batch.column("file"), batch.column("block"), batch.column("data")):
            yield file.as_py(), block.as_py(), data.as_py()


_CANDIDATE = f"file long, block long, at long, next long, exit long, whole boolean, {_RECORD}"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate, and one for each block with at = -1 and its length in next.

    at is where what follows the magic begins, counted from that of the block's first segment; next is where the successor's
    would; exit is the first of the chain that lies beyond the block, or -1 where the chain breaks. whole: the record holds no
    other magic, so that it has been read.
    """
    key, rows, at = None, [], 0

    def ended() -> Iterator[pa.RecordBatch]:
        by_place = {r["at"]: r for r in rows}
        for r in reversed(rows):
            r["exit"] = r["next"] if r["next"] >= at else by_place[r["next"]]["exit"] if r["next"] in by_place else -1
        rows.append({"file": key[0], "block": key[1], "at": -1, "next": at})
        for i in range(0, len(rows), 10_000):
            yield _frame(rows[i : i + 10_000], _CANDIDATE)

    for file, block, data in _rows(batches):
        if key != (file, block):
            if key:
                yield from ended()
            key, rows, at = (file, block), [], 0
        if head := _head(data):
            begin, length, found = head
            whole = len(data) >= begin + length
            rows.append({"file": file, "block": block, "at": at, "next": at + begin + length + 4 + _SKIP, "whole": whole} | (_record(found, data[begin : begin + length]) if whole else {}))
        at += len(data) + _SKIP
    if key:
        yield from ended()


def _mark(rows: pa.Table) -> pa.Table:
    """Of a block's candidates, those on the chain from its entry. In Arrow, where longs with nulls stay longs."""
    nexts = rows.column("next").to_pylist()
    place = {a: i for i, a in enumerate(rows.column("at").to_pylist())}
    at, kept = rows.column("entry")[0].as_py(), []
    while at in place:
        kept.append(place[at])
        at = nexts[kept[-1]]
    return rows.take(pa.array(kept, pa.int64())).drop_columns(["entry"])


def _assemble(rows: pd.DataFrame) -> pd.DataFrame:
    """One record from its segments."""
    rows = rows.sort_values("place")
    data = MAGIC.join(bytes(x) for x in rows["data"])
    begin, length, found = _head(data)
    return pd.DataFrame([_record(found, data[begin : begin + length])], columns=_FIELDS).astype({n: "Int64" for n in ("page_id", "payload_bytes", "refers_to")})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their place in the block."""
    key, at = None, 0
    for batch in batches:
        places = []
        for file, block, data in zip(batch.column("file"), batch.column("block"), batch.column("data")):
            if key != (now := (file.as_py(), block.as_py())):
                key, at = now, 0
            places.append(at)
            at += len(data.as_buffer()) + _SKIP
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("data")], names=["file", "block", "at", "data"])


def _bases(found: DataFrame) -> DataFrame:
    """file, block, base, size: where each block's first segment begins in its file. A row for each block."""
    blocks = found.filter("at = -1").select("file", "block", F.col("next").alias("size"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return saved(blocks.withColumn("base", F.coalesce(F.sum("size").over(ahead), F.lit(0))), "blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, page_id, payload_bytes, payload_digest, refers_to of every record in the files of a folder.

    The digest of a response is computed from what was read; a revisit has that of its header and the length that its HTTP header
    gives. Only records on the chain from their file's first byte are returned; where a chain breaks (a file cut short or a
    wrong length), it ends. Files may be split anywhere, and payloads may hold any bytes, whole WARC records included.
    """
    seed = _seed(spark, path)
    found = saved(_segments(spark, path, seed).mapInArrow(_candidates, _CANDIDATE), "candidates")
    bases = _bases(found)
    chain = join_small(found.filter("at >= 0").select("file", "block", "at", "exit"), bases, ["file", "block"], "inner")
    chain = chain.select("file", "block", (F.col("base") + F.col("at")).alias("place"), F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")).alias("exit"))
    jump = saved(chain, "chain")
    entries = saved(jump.filter(F.col("place") == _SKIP).select("file", "place"), "entries")
    count = -1
    while (now := entries.count()) != count:
        count = now
        hops = entries.join(jump.hint("merge"), ["file", "place"]).select("file", F.col("exit").alias("place"))
        entries_next = entries.unionByName(hops.join(jump.select("file", "place").hint("merge"), ["file", "place"], "left_semi")).distinct()
        target = jump.select("file", F.col("place").alias("exit"), F.col("exit").alias("further")).hint("merge")  # as many rows as jump
        jump = saved(jump.join(target, ["file", "exit"], "left").select("file", "block", "place", F.coalesce("further", "exit").alias("exit")), "chain")
        entries = saved(entries_next, "entries")
    entry = entries.join(jump.select("file", "block", "place").hint("merge"), ["file", "place"]).join(bases, ["file", "block"]).select("file", "block", (F.col("place") - F.col("base")).alias("entry"))
    marked = found.filter("at >= 0").join(entry, ["file", "block"]).groupBy("file", "block").applyInArrow(_mark, _CANDIDATE)
    records = saved(marked, "records")
    whole = records.filter("whole").select(*_FIELDS)
    broken = join_small(records.filter("not whole").select("file", "block", "at", "next"), bases, ["file", "block"], "inner")
    spans = saved(broken.select("file", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("next")).alias("stop")), "spans")
    if spans.isEmpty():
        return whole
    parts = bases.join(spans, "file").filter("start < base + size and stop > base").select("file", "block", "base", "start", "stop")
    pieces = _segments(spark, path, seed).mapInArrow(_cut, "file long, block long, at long, data binary")
    own = join_small(pieces, saved(parts, "parts"), ["file", "block"], "inner").withColumn("place", F.col("base") + F.col("at"))
    own = own.filter("place >= start and place < stop").select("file", "start", "place", "data")
    return whole.unionByName(own.groupBy("file", "start").applyInPandas(_assemble, _RECORD))


def written_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, from the files that write() made of them."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
