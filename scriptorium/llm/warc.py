"""WARC archives of pages, written and read back with boundary-chain verification.

Writing. Every page is one WARC/1.1 record. The text sink writes the archives: a row is a record's header and
payload, and the line separator is the empty line that ends a record, so executors write valid archives to any
Hadoop store. Of pages with equal payloads that with the smallest id is a ``response`` record with the payload;
the others are ``revisit`` records that refer to it and hold no payload. A response's block is an HTTP response (a short head, then the
payload), as the format asks for; the page's address is the target, line breaks in it escaped. Only digests are shuffled, grouped with
partial aggregation; the groups with copies come back to the pages by a broadcast if there are few, else by a
shuffled join.

Reading. Tasks look for the magic at every offset of an archive and emit record-to-successor links: the offset, and
the offset at which the header's length says that the next record starts. A payload may hold the magic, so the
links are then followed from the file's start by pointer jumping (links are squared, the reached set doubles a round)
and only reachable records stay. A file is bounded in bytes: pages up to ``SMALL`` bytes stand ``RECORDS`` to a file; larger ones in files of their own
class, where each doubling of the size halves the records. So a file has about SMALL * RECORDS bytes at most, or is one page.

Results for odd rows: a null html is an empty payload (which is deduplicated like any other: the least size is 0 bytes);
rows that repeat the smallest id of their group are all responses; a null id counts as larger than any other, and a group
of null ids only is all responses; an empty table gives an empty result; other columns are dropped. A broken header raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import join_sized, new_dir, table, tune

MAGIC, END = b"WARC/1.1\r\n", "\r\n\r\n"
#: Most records of an archive file, and bytes of a page up to which there are so many.
RECORDS, SMALL = 2_000, 16_384
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every 5 hexadecimal digits are 4 letters."""

    def letters(hexed: Column) -> Column:
        group = lambda i: F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        # shiftright wants a constant, so the group is divided.
        letter = lambda i: F.substring(F.lit(BASE32), (F.floor(group(i) / F.pow(F.lit(2.0), 15 - 5 * (i % 4))).cast("int") % 32) + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    # As a lambda's argument the sum is taken once a payload.
    return F.transform(F.array(F.sha1(payload)), letters)[0]


def with_types(pages: DataFrame, key: str, url_col: str, html_col: str) -> DataFrame:
    """(key, _url, _payload, payload_bytes, payload_digest, record_type, refers_to, _refers_url)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(key), url.alias("_url"), payload.alias("_payload")).withColumn("payload_bytes", F.octet_length("_payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("_payload").cast("binary")))
    groups = rows.groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("_first"), F.min_by("_url", key).alias("_first_url"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = join_sized(rows, groups, ["payload_digest", "payload_bytes"])
    again = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return joined.select(*rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"), F.when(again, F.col("_first_url")).alias("_refers_url"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the archives of the pages into a folder of the shared store."""
    typed = with_types(pages, key, url_col, html_col)
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HEAD), F.col("payload_bytes").cast("string"), F.lit(END), F.col("_payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.col(key))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("_url")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))),
        F.when(again, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("_refers_url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.octet_length(block).cast("string"))),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(again, F.lit("")).otherwise(block))
    # By size: the class of the payload, the number of times RECORDS is halved.
    times = lambda size: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(float(SMALL))))).cast("int")
    sizes = pages.select(times(F.octet_length(F.coalesce(F.col(html_col), F.lit("")))).alias("times")).groupBy("times").count().collect()  # a few rows: at most 18 classes
    for n in sorted(r["times"] for r in sizes) or [0]:
        part = typed.where(times(F.col("payload_bytes")) == n) if len(sizes) > 1 else typed
        part.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(1, RECORDS >> n)).text(f"{path}/size={n}")


HEADER = re.compile(rb"WARC/1\.1\r\n((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n") if line)


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) with every candidate's offset and successor, and what its header and payload say."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, at = [], content.find(MAGIC)
            while at >= 0:
                head = HEADER.match(content, at)
                fields = _fields(head[1]) if head else {}
                if "Content-Length" in fields and fields["Content-Length"].isdigit():
                    block = content[head.end() : head.end() + int(fields["Content-Length"])]
                    # What follows an HTTP head is the payload.
                    body = block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block
                    response = fields.get("WARC-Type") == "response"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if response else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    size = len(body) if response else int(fields.get("WARC-Payload-Length", "-1"))
                    name = lambda k: v[10:-1] if (v := fields.get(k, "")).startswith("<urn:page:") and v != "<urn:page:null>" else None  # noqa: B023, E731
                    rows.append((at, head.end() + int(fields["Content-Length"]) + len(END), name("WARC-Record-ID"), size, digest, fields.get("WARC-Type"), name("WARC-Refers-To"), fields.get("WARC-Target-URI")))
                at = content.find(MAGIC, at + 1)
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([len(content)] * len(rows), pa.int64()), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]],
                names=["path", "length", "offset", "successor", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"],
            )


def reachable(offsets: np.ndarray, successors: np.ndarray, length: int) -> np.ndarray:
    """Which records the chain from offset 0 reaches, by pointer jumping; offsets are sorted."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors)
    jump = np.append(np.where(hit, at, n), n)  # n: the end, and where a broken link goes
    reached = np.zeros(n + 1, bool)
    if not n or offsets[0] != 0:
        raise ValueError("an archive doesn't start with a record")
    reached[0] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        if (more == reached).all() and (jump == jump[jump]).all():
            break
        reached, jump = more, jump[jump]
    found = reached[:n]
    if successors[found].max() != length:
        raise ValueError("an archive's chain of records doesn't end at its end")
    return found


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: page_id and refers_to as strings, payload_bytes, payload_digest, record_type, target."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    candidates = files.mapInArrow(links, f"path string, length long, offset long, successor long, {FIELDS}")

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        found = reachable(group["offset"].to_numpy(), group["successor"].to_numpy(), group["length"][0].as_py())
        return group.filter(pa.array(found)).select(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])

    return candidates.groupBy("path").applyInArrow(follow, FIELDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    path = new_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


QUERIES = {"op10_warc": op10_warc}
SQL: dict[str, str] = {}
