"""Web archives with repeated payloads resolved to revisit records.

Only headers (page id, payload digest) are shuffled to find, for each digest, the record that holds the
payload; revisit records are then joined to it. New archives are written with fresh headers: a response
record with its payload for each distinct payload, and a revisit record that names it for every other page. Records are
gzip members of their own, so an archive can be read from any record on. Reading resolves
revisits again by a join with the responses.

Defined results: a null html is an empty payload, and empty payloads count as equal; of pages with equal
payloads those that have the smallest id are responses (repeated rows are each), and where no page has an id all are;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.files import Whole, place
from evenkeel.llm.frames import map_batches
from evenkeel.session import materialise, scratch_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_READ = 1 << 20


def digest(payload: bytes) -> str:
    """The base-32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """The record id of a page's response: always the same, so that revisits can name it before it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(kind: str, url: str, date: str, block: bytes, **more: str | None) -> bytes:
    heads = {
        "WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)), "WARC-Block-Digest": "sha1:" + digest(block),
    } | {k.replace("_", "-"): v for k, v in more.items()}
    lines = [f"{k}: {v}".encode() for k, v in heads.items() if v is not None]
    data = b"\r\n".join([VERSION, *lines]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, one gzip member at a time."""
    files, path = place(uri)
    with files.open_input_stream(path, compression=None) as f:
        left = b""
        while left or (left := f.read(_READ)):
            unpack, data = zlib.decompressobj(31), io.BytesIO()
            while not unpack.eof:
                if not left and not (left := f.read(_READ)):
                    raise ValueError(f"{uri} ends within a record")
                data.write(unpack.decompress(left))
                left = unpack.unused_data if unpack.eof else b""
            head, _, rest = data.getvalue().partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError(f"{uri}: not a record: {lines[0][:40]}")
            heads = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(heads["Content-Length"])]
            if heads["WARC-Block-Digest"] != "sha1:" + digest(block):
                raise ValueError(f"{uri}: a damaged record")
            yield heads, block


def resolve(headers: DataFrame) -> DataFrame:
    """The headers (page_id, url, sha) with the response that each refers to and its url; null for responses.

    Originals are found by partial minima and written once, so that both sides of the join are plain shuffles, of
    which a hot digest's can be split.
    """
    first = headers.groupBy("sha").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1 and original is not null").drop("n"), "originals")
    named = headers.select("sha", F.col("page_id").alias("original"), "url").join(first, ["sha", "original"])
    named = materialise(named.groupBy("sha", "original").agg(F.min("url").alias("original_url")), "originals")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    out = headers.join(named, "sha", "left")
    return out.select(
        "page_id", "sha", F.when(revisit, F.col("original")).alias("refers_to"), F.when(revisit, F.col("original_url")).alias("refers_to_url")
    )


def write(pages: DataFrame, path: str, date: str | None = None) -> DataFrame:
    """Write (page_id, url, html) as archives below path; (file, records) of each."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1("html"))
    # Headers travel alone until it is settled what becomes of each; the payloads are shuffled once, to their writers.
    heads = materialise(resolve(materialise(pages.select("page_id", "url", "sha"), "headers")).distinct(), "headers")
    heads = heads.withColumnsRenamed({"page_id": "__id", "sha": "__sha"})
    spread = pages.join(heads, pages["page_id"].eqNullSafe(heads["__id"]) & (pages["sha"] == heads["__sha"]), "left")
    spread = spread.select("page_id", "url", "html", "refers_to", "refers_to_url")

    def store(batches):
        name, n = f"{path}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with Whole(name) as out:
            for b in batches:
                for page, url, html, refers, refers_url in zip(*(c.to_pylist() for c in b.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    uri, sha = " ".join((url or "").split()) or f"urn:page:{page}", "sha1:" + digest(payload)
                    # What a page is called here travels in a header of its own.
                    own = {"X_Page_Id": None if page is None else str(page), "WARC_Payload_Digest": sha}
                    http = _HTTP % len(payload)
                    if refers is None:
                        out.write(_record("response", uri, date, http + payload, WARC_Record_ID=record_id(page), **own))
                    else:
                        named = {"WARC_Refers_To": record_id(refers), "WARC_Refers_To_Target_URI": refers_url and " ".join(refers_url.split())}
                        own |= named | {"WARC_Refers_To_Date": date, "WARC_Profile": PROFILE, "X_Refers_To_Page": str(refers)}
                        out.write(_record("revisit", uri, date, http, WARC_Record_ID=f"<urn:uuid:{uuid.uuid4()}>", **own))
                    n += 1
        yield [[name], [n]]

    # One row per archive, not per record.
    rows = [tuple(r) for r in map_batches(spread, store, "file string, records bigint").collect() if r["records"]]
    return pages.sparkSession.createDataFrame(sorted(rows), "file string, records bigint")


def read(files: DataFrame) -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    n = max(1, files.count())

    def load(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                out = [[] for _ in range(6)]
                for heads, block in records(name):
                    kind, refers = heads["WARC-Type"], heads.get("X-Refers-To-Page")
                    payload = block.partition(b"\r\n\r\n")[2]
                    said = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and said != digest(payload):
                        raise ValueError(f"{name}: a damaged payload")
                    page = heads.get("X-Page-Id")
                    row = (page and int(page), len(payload) if kind == "response" else None, said, kind, refers and int(refers))
                    for column, x in zip(out, (*row, heads["WARC-Target-URI"])):
                        column.append(x)
                yield out

    kind = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    found = map_batches(files.select("file").repartition(n, "file"), load, kind)
    found = materialise(found, "records")
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__size"))
    out = found.join(materialise(sizes, "sizes"), "payload_digest", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "__size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to deduplicated archives in the shared folder and read them back."""
    return read(write(pages, scratch_path(pages.sparkSession, "archives")))
