"""WARC: a content-addressed archive.

`write_archive` keeps each payload once, by SHA-256 of its bytes, in a payload table, and the
exact header bytes of every record in a header table. A digest is taken as proof of equality
only after a check: rows of a digest must agree in length and in the SHA-1 and MD5 of the
bytes, else the job fails. `read_archive` joins the two tables and gives back each WARC/1.1
record, byte for byte; `parse_records` reads such bytes, with any WARC header lines.
`export_files` and `read_files` carry records to and from gzip members in .warc.gz files.

Of records with equal payloads of at least min_bytes bytes, the one with the largest id is the
response, others are revisits that name it; smaller ones are all responses.

Payloads move once, from the rows that own them; the many rows of a large group of copies
carry digests only, and pre-aggregated owners meet them in a join that Spark may split.

Defined results: null html is an empty payload; a null url gives no WARC-Target-URI line; blanks and
control characters of a url are percent-encoded in the header, and the header table has the url as it is; rows
with a null id are archived as responses of their own unless a row with an id owns the payload,
and then revisit it; repeated rows (same id, same payload) are the same record and all of them
take part, the owner's repeats as responses; very long payloads are one record each; an empty
table gives an empty archive. Other columns play no part.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, qualified, write_table

DATE = "2024-01-31T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Characters that would end a header line or a field; the header has them percent-encoded, the column `url` as they are.
CONTROL = [*range(33), 127]
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexes: Column) -> Column:
    """Hexadecimal digits, a multiple of five of them, as base32: five of them are four characters."""

    def four(k: Column) -> Column:
        bits = F.conv(F.substr(hexes, 5 * k + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(hexes) / 5).cast("int") - 1), four), "")


def header_value(url: Column) -> Column:
    """url without characters that could start another header line."""
    encoded = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}")), CONTROL, url)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(url)


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """A row a page: digests, length, type and refers_to."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.md5("payload").alias("md5"), F.octet_length("payload").cast("long").alias("n"))
    owners = rows.groupBy("digest").agg(
        F.max("page_id").alias("owner"),
        F.assert_true((F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1")) & (F.min("md5") == F.max("md5")), F.lit("two payloads share a SHA-256 digest")).alias("_ok"),
    )
    df = rows.join(owners, "digest").where("_ok IS NULL")
    first = (F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("owner")) | F.col("owner").isNull()
    return df.select("page_id", "url", "digest", "sha1", "n", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("owner")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Writes path/headers and path/payloads."""
    rec = records(pages, id_col, url_col, payload_col, min_bytes)
    sha1 = base32(F.col("sha1"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(name + ": "), c, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit(HTTP), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.lit(0))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", header_value(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("b32"))), line("WARC-Refers-To", urn(F.col("refers_to").cast("string"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))), line("WARC-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"),
    )
    heads = rec.withColumn("b32", sha1).withColumn("http", http).select("page_id", "url", "record_type", "refers_to", F.when(F.col("record_type") == "response", F.col("digest")).alias("digest"), F.concat(warc, "http").cast("binary").alias("head"))
    write_table(heads, f"{path}/headers")
    # of each digest one page: rows meet it by digest and page, so that many copies do not gather, and what is left needs no second shuffle
    page = [F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("none")]
    owned = rec.where("record_type = 'response'").groupBy("digest").agg(F.max("page_id").alias("page_id")).select("digest", *page)
    content = pages.select(F.col(id_col).cast("long").alias("page_id"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    content = content.select(F.sha2("payload", 256).alias("digest"), *page, "payload")
    once = content.join(owned.hint("merge"), ["digest", "id", "none"], "left_semi").dropDuplicates(["digest", "id", "none"])
    write_table(once.select("digest", "payload"), f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, record): the exact bytes of each WARC record, from the header and payload tables."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    full = heads.where("digest IS NOT NULL").join(payloads, "digest", "left").select("page_id", F.concat("head", "payload", F.lit(b"\r\n\r\n")).alias("record"))
    bare = heads.where("digest IS NULL").select("page_id", F.concat("head", F.lit(b"\r\n\r\n")).alias("record"))
    return full.unionByName(bare)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields by lower-case name, HTTP header, payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


PARSED = "page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def parse_records(df: DataFrame, digests_only: bool = False) -> DataFrame:
    """Rows (record) to what the records say; a response's payload is checked against its digest and length."""

    def number(urn: str | None) -> int | None:
        found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found.lstrip("-").isdigit() else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = []
            for raw in batch["record"]:
                f, _, payload = parse_record(bytes(raw))
                digest, n = f["warc-payload-digest"].removeprefix("sha1:"), int(f["warc-payload-length"])
                if f["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, n):
                    raise ValueError("a payload differs from its digest")
                out.append((number(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"), n, digest, number(f.get("warc-refers-to")), None if digests_only else payload))
            made = pd.DataFrame(out, columns=["page_id", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to", "payload"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return df.select("record").mapInPandas(parse, PARSED)


def export_files(records: DataFrame, path: str) -> DataFrame:
    """Writes records as gzip members, a .warc.gz file a task, through Arrow's file systems; rows (file, records) name the files that count."""
    path = qualified(records.sparkSession, path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for raw in batch["record"]:
                    out.write(gzip.compress(bytes(raw), mtime=0))
                    n += 1
        yield pd.DataFrame({"file": [name], "records": [n]})

    return records.select("record").mapInPandas(write, "file string, records long")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """Rows (file) of export_files to rows (record), a member at a time."""
    root = qualified(files.sparkSession, root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as text:
                    while first := text.readline():
                        head = first
                        while (line := text.readline()) != b"\r\n":
                            head += line
                        n = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        yield pd.DataFrame({"record": [head + b"\r\n" + text.read(n + 4)]})

    return files.select("file").mapInPandas(read, "record binary")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parse_records(read_archive(spark, path), digests_only=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

