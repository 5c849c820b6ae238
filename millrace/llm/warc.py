"""WARC archives: writing page records and reading them back by boundary-chain verification.

Writing. A page's payload is its html in UTF-8. Rows with equal payloads (SHA-1 and length) of at least
``min_revisit_bytes`` form a group; the row with the largest page id is written as ``response`` and the others as
``revisit`` of it, without payload. Groups are reduced to their largest id before the shuffle that brings it back to
the rows, and adaptive execution splits that join where a group is hot. Records go through Spark's own text writer,
so any store works, files appear only when a task commits, and a lost task is written again.

Reading. The text reader cuts the files at the magic ``WARC/1.0\\r\\n``. A piece is only a *candidate* record, since
a payload may hold the same bytes. Tasks give each candidate its offset and, by its Content-Length, the offset of its
successor. Offsets count from the start of the split that a task reads; sums over the splits before it make them
absolute, so that large uncompressed files are read in parallel. Pointer jumping from offset 0 doubles the known part
of each file's chain in every round and keeps only reachable records. Candidates that are not reachable are pieces of
the payload before them and are joined to it again.

Nulls and edge cases: null html is the empty payload; a null url is written as an empty one, control characters in it
as %20; a null page id is left out of the record and comes back null, and it is never the id referred to unless all ids
of its group are null (then all are ``response``); repeated rows that share the largest id are all ``response``;
empty pages give empty archives and an empty result; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, remove_path, settle, shared_dir, table

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: 40 hex digits are eight groups of 20 bits, four base32 digits each."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _name() -> Column:
    """A record's UUID from its id, url and payload, the same in every run."""
    digest = F.md5(F.concat_ws(" ", F.col("id").cast("string"), "url", "sha"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One column ``value``: the record of each page, without the blank lines that end it."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    heads = rows.filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("head"))
    rows = rows.join(heads, ["sha", "bytes"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("id"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _name(), F.lit(">\r\n")),
        F.concat(F.lit("WARC-Target-URI: "), clean, F.lit("\r\n")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha"), F.lit("\r\n")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nX-Refers-To-Page: "), F.col("head").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("id").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string"), F.lit("\r\n")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(END.decode()),
    )
    return rows.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 50_000, compression: str = "gzip", **names) -> None:
    out = records(pages, **names).write.option("lineSep", END.decode()).option("compression", compression)
    out.option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = "type string, id long, bytes long, sha string, refers long, length long"
_PLACE = "file string, split long, start long"
_CANDIDATE = f"{_PLACE}, stop long, succ long, whole boolean, {_FIELDS}"


def _header(piece: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Where the block begins, and the named fields; None if this is no record."""
    end = piece.find(END)
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(rb"\d{1,18}", fields.get(b"content-length", b"")):
        return None
    return end + 4, fields


def _number(x: bytes | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(rb"-?\d{1,19}", x) else None


def _describe(fields: dict[bytes, bytes], block: bytes) -> dict:
    """A record's row: what its header says, and for a payload what the bytes themselves say."""
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    out = {"type": kind, "id": _number(fields.get(b"x-page-id")), "refers": _number(fields.get(b"x-refers-to-page")), "length": len(block)}
    if kind == "revisit":
        out |= {"bytes": _number(fields.get(b"x-payload-length")), "sha": fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")}
    else:
        out |= {"bytes": len(block), "sha": base64.b32encode(hashlib.sha1(block).digest()).decode()}
    return out


def _pieces(batch: pa.RecordBatch, state: dict) -> Iterator[tuple[str, int, int, int, bytes]]:
    """File, split, offset of the magic and of the next one (both from the split's start), and content of each piece."""
    for file, split, value in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
        piece = value.as_py() or b""
        if state.get("now") != (file, split):
            state["now"], state["at"] = (file, split), 0
        begin = state["at"]
        state["at"] += len(piece) + len(MAGIC)
        if split or begin:
            yield file, split, begin - len(MAGIC), state["at"], piece
        elif piece:  # the first piece of a file is what comes before the first magic
            raise ValueError(f"{file} does not begin with a record")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("succ", pa.int64()), ("whole", pa.bool_()), ("type", pa.string()), ("id", pa.int64()), ("bytes", pa.int64()), ("sha", pa.string()), ("refers", pa.int64()), ("length", pa.int64())])
    state: dict = {}
    for batch in batches:
        rows = []
        for file, split, start, stop, piece in _pieces(batch, state):
            row = {"file": file, "split": split, "start": start, "stop": stop, "whole": False}
            if found := _header(piece):
                body, fields = found
                length = int(fields[b"content-length"])
                row["succ"] = start + len(MAGIC) + body + length + len(END)
                if len(piece) == body + length + len(END) and piece.endswith(END):
                    row |= _describe(fields, piece[body : body + length]) | {"whole": True}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("start", pa.int64()), ("raw", pa.binary())])
    state: dict = {}
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{"file": f, "split": s, "start": at, "raw": piece} for f, s, at, _, piece in _pieces(batch, state)], schema)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose payload holds the separator, from their pieces in order."""
    schema = pa.schema([("type", pa.string()), ("id", pa.int64()), ("bytes", pa.int64()), ("sha", pa.string()), ("refers", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        rows = []
        for value in batch[0]:
            pieces = [x["raw"] for x in sorted(value.as_py(), key=lambda x: x["start"])]
            found = _header(whole := MAGIC.join(pieces))
            if not found:
                raise ValueError("a reachable record has no valid header")
            body, fields = found
            block = whole[body : body + int(fields[b"content-length"])]
            if len(block) != int(fields[b"content-length"]):
                raise ValueError("an archive ends inside a record")
            rows.append(_describe(fields, block))
        yield pa.RecordBatch.from_pylist(rows, schema)


def reachable(nodes: DataFrame) -> DataFrame:
    """``file, start`` of the records on each file's chain from offset 0, by pointer jumping.

    ``nodes`` has ``file, start, succ``. After k rounds the first 2^k records of every file are known.
    """
    known = nodes.filter("start = 0").select("file", "start")
    jump = nodes.filter("succ IS NOT NULL").select("file", "start", F.col("succ").alias("to"))
    seen, n = -1, known.count()
    while n != seen:
        seen = n
        ahead = known.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        landed = ahead.join(nodes.select("file", "start"), ["file", "start"], "left_semi")
        known = settle(known.union(landed).distinct())
        then = jump.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jump = settle(jump.join(then, ["file", "to"]).select("file", "start", F.col("further").alias("to")))
        n = known.count()
        release(nodes.sparkSession)  # each round replaces the tables of the one before
    return known


def read_archives(spark: SparkSession, path: str, broadcast_pieces: int = 50_000) -> DataFrame:
    """One row per record: ``type, id, bytes, sha, refers, length``."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    found = settle(pieces.mapInArrow(_candidates, _CANDIDATE))
    # a file has few splits; sums over those before give each one's place
    splits = found.groupBy("file", "split").agg(F.max("stop").alias("stop"))
    before = F.sum("stop").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = settle(splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("base")))
    found = found.join(splits, ["file", "split"]).withColumn("start", F.col("start") + F.col("base")).withColumn("succ", F.col("succ") + F.col("base"))
    found = settle(found.withColumn("stop", F.col("stop") + F.col("base")).drop("base", "split"))
    known = reachable(found.select("file", "start", "succ")).withColumn("known", F.lit(True))
    marked = found.join(known, ["file", "start"], "left")
    ends = marked.groupBy("file").agg(F.max(F.when(F.col("known"), F.col("succ"))).alias("chain"), (F.max("stop") - len(MAGIC)).alias("end"))
    broken = ends.filter(~F.col("chain").eqNullSafe(F.col("end"))).first()
    if broken is not None:
        raise ValueError(f"{broken['file']} ends inside a record")
    good = marked.filter("known AND whole").select("type", "id", "bytes", "sha", "refers", "length")
    # what is left is rare: records with the separator in their payload, and the pieces that follow them
    owner = F.last(F.when(F.col("known"), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    rest = marked.filter("known IS NULL OR NOT whole").select("file", "start", "known").withColumn("owner", owner).filter("owner IS NOT NULL")
    rest = settle(rest.select("file", "start", "owner"))
    if rest.isEmpty():
        return good
    # only now are contents read again; a long list of pieces is joined by a shuffle
    small = rest.limit(broadcast_pieces + 1).count() <= broadcast_pieces
    placed = pieces.mapInArrow(_contents, f"{_PLACE}, raw binary").join(splits, ["file", "split"]).withColumn("start", F.col("start") + F.col("base"))
    joined = placed.join(F.broadcast(rest) if small else rest, ["file", "start"]).groupBy("file", "owner").agg(F.collect_list(F.struct("start", "raw")).alias("pieces"))
    return good.unionByName(joined.select("pieces").mapInArrow(_rebuild, _FIELDS))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of all pages. The archives are removed once the records read from them are settled, or a step fails."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(table(spark, sf_dir, "pages"), path)
        back = settle(read_archives(spark, path))
    finally:
        remove_path(spark, path)
    return back.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s FROM p
), e AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM d
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM e
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM page_id THEN NULL ELSE head END AS refers_to
FROM g
"""
