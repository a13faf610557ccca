"""WARC archives: a writer and a splittable reader of gzip members, one per record.

Archives are read by byte ranges: Spark's text source takes the gzip magic as its line separator, so a task gets the
stretches between magics of its range, and owns those that start inside it even where they end beyond. A stretch
begins a record if it decodes to a WARC header; any other magic lay inside compressed data, and its stretch goes on
with the one before. Pieces of a record that a range border parts from its beginning are put together afterwards.
Everything goes through Spark's sources and sinks, so archives may lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach.sources.workspace import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are stored once.
LEAST_REVISIT_BYTES = 0
#: Members are handed to the file writer in runs of about this many bytes.
RUN_BYTES = 1 << 20
RECORD = "record_id string, record_type string, target_uri string, refers_to string, digest string, http_length long, payload_bytes long, payload binary"
FRAGMENT = "path string, block long, place long, fragment binary"


def member(data: bytes) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: bytes, content: str, **fields: str | None) -> bytes:
    """A WARC record; fields without value are left out, control characters in values are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    for name, value in fields.items():
        if value is not None:
            clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
            lines.append(f"WARC-{name.replace('_', '-')}: {clean}")
    lines += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: The text sink writes this after each run of members: a record of its own, so that archives hold nothing but records.
SEPARATOR = member(record("warcinfo", "<urn:archive:run>", b"software: newsreach\r\n", "application/warc-fields"))


def page_urn(page_id) -> str:
    return "<urn:page:none>" if pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (NULL as empty), response_id: the largest page_id of an equal payload of at least ``least`` bytes.

    Only digests and ids are grouped, combined before the shuffle; joining a crowded digest back is left to the
    engine's splitting of skewed joins.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.withColumn("payload_sha1", F.sha1(F.col("html").cast("binary")))
    groups = marked.groupBy("payload_sha1").agg(F.max("page_id").alias("response_id"))
    alone = F.octet_length("html") < least
    return marked.join(groups, "payload_sha1").select("page_id", "url", "html", F.when(alone, F.col("page_id")).otherwise(F.col("response_id")).alias("response_id"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as WARC files under ``path``.

    Of equal payloads that of the largest page_id is a response (each of its rows, if it occurs repeatedly) and the
    others are revisits of it, with the payload's length but not the payload. A NULL page_id is a revisit unless no
    row of its payload has an id. Extra columns are not written. No rows give no records.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size = [], 0
        for batch in batches:
            for page, url, html, response in zip(batch["page_id"], batch["url"], batch["html"], batch["response_id"]):
                payload = html.encode()
                own = (pd.isna(page) and pd.isna(response)) or page == response
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = {"Target_URI": url, "Payload_Digest": f"sha1:{base32_sha1(payload)}"}
                if not own:
                    fields |= {"Refers_To": page_urn(response), "Profile": PROFILE}
                done = member(record("response" if own else "revisit", page_urn(page), head + payload * own, "application/http;msgtype=response", **fields))
                run.append(done)
                size += len(done)
                if size >= RUN_BYTES:
                    yield pd.DataFrame({"value": [b"".join(run)]})
                    run, size = [], 0
        if run:
            yield pd.DataFrame({"value": [b"".join(run)]})

    # Strings of the engine are bytes: the cast and the text sink leave them as they are.
    runs = with_roles(pages, least).mapInPandas(members, "value binary").select(F.col("value").cast("string"))
    runs.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).option("compression", "none").text(path)


def starts_record(stretch: bytes) -> bool:
    """Whether a stretch is the beginning of a member that holds a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(stretch[:4096], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def parse(data: bytes, keep_payload: bool) -> tuple:
    """Fields of one record. The payload's length and digest are measured where the payload is there."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = block[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind = fields.get("WARC-Type")
    full = kind == "response"
    digest = base32_sha1(payload) if full else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    return (
        fields.get("WARC-Record-ID"), kind, fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), digest,
        int(length[1]) if length else None, len(payload) if full else None, payload if full and keep_payload else None,
    )


def inflate(data: bytes) -> bytes | None:
    """Content of a whole member, None if it is not whole."""
    try:
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(data)
        return out if unpack.eof else None
    except zlib.error:
        return None


NAMES = [x.split()[0] for x in f"{RECORD}, {FRAGMENT}".split(", ")]


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({name: "Int64" for name in ("http_length", "payload_bytes", "block", "place")})


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the WARC files under ``path``: id, type, target, refers_to, digest, lengths, payload.

    Members may be of any size and hold the magic anywhere. ``keep_payload=False`` measures payloads and drops them.
    Stretches that belong to no record (damage, padding) are left out. The records are written to the shared folder
    once, as the parted ones are told from the others by a second look.
    """
    stretches = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    stretches = stretches.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    nothing = (None,) * 8

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, place, pending, begun = None, 0, [], False

        def close() -> list[tuple]:
            nonlocal place
            if not pending:
                return []
            data = b"".join(pending)
            content = inflate(data) if begun else None
            place += 1
            if content is not None:
                return [parse(content, keep_payload) + (None,) * 4]
            return [(*nothing, *where, place, data)]

        for batch in batches:
            rows: list[tuple] = []
            for value, file, block in zip(batch["value"], batch["path"], batch["block"]):
                if (file, block) != where:
                    rows += close()
                    where, place, pending, begun = (file, block), 0, [], False
                    if block == 0 and not value:
                        continue  # what stands before the first magic of a file
                stretch = MAGIC + value
                if starts_record(stretch):
                    rows += close()
                    pending, begun = [stretch], True
                else:
                    pending.append(stretch)
            yield frame(rows)
        yield frame(close())

    found = materialize(stretches.mapInPandas(scan, f"{RECORD}, {FRAGMENT}"), "warc-records")

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        rows, pending = [], b""
        for data in parts.sort_values(["block", "place"])["fragment"]:
            pending = data if starts_record(data) else pending + data
            content = inflate(pending) if pending else None
            if content is not None:
                rows.append(parse(content, keep_payload) + (None,) * 4)
                pending = b""
        return frame(rows)

    parted = found.where(F.col("fragment").isNotNull()).groupBy("path").applyInPandas(join, f"{RECORD}, {FRAGMENT}")
    return found.where(F.col("fragment").isNull()).union(parted).drop("path", "block", "place", "fragment")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back and give a row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response, for revisits).
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return read(spark, path, keep_payload=False).where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), F.coalesce("payload_bytes", "http_length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
