"""WARC archives: written, indexed, and read through the index by byte range.

* ``write_archives``: one record per page. Of pages with equal payloads of at least ``min_bytes``,
  that with the smallest page id is a ``response``, the others are ``revisit`` records that refer to it and
  hold the HTTP head only. Spark's text writer makes the files: a record ends with CR LF CR LF, which is
  the writer's line separator, so that commits and lost tasks are Spark's business.
* ``build_index``: file, offset, length, URL and digest of each record, from one pass over the archives.
* ``read_records``: the selected rows of the index, read as sorted byte ranges, neighbours at once.

A null payload is empty; a null URL leaves out the target header. A null page id sorts last when the
response is chosen. Rows that share a page id are written one by one; those that hold the
smallest id of their payload are all responses. Further columns are not read. A payload may hold any bytes, record ends too: lengths,
not separators, tell where a record ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.stores import read_ranges, store
from tallyflow.llm.texts import arrow_schema
from tallyflow.runtime import Scratch

MIN_BYTES = 100
DATE = "2000-01-01T00:00:00Z"  # one capture date: equal inputs give equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
END = "\r\n\r\n"
BUFFER = 4 << 20


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a smaller id has."""
    seen = pages.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")).filter(F.col("n") >= min_bytes)
    groups = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    copies = seen.drop("n").join(groups.filter(F.col("n") > 1).drop("n"), "digest")
    return copies.filter(F.coalesce(F.col("page_id") != F.col("refers_to"), F.col("refers_to").isNotNull())).distinct()


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The text of each record without its last CR LF CR LF."""
    # written, so that its size is known: a small table goes to the pages, and only a large one makes them move
    known = revisits(pages, min_bytes).select(F.col("page_id").alias("_id"), F.xxhash64("digest").alias("_digest"), "refers_to")
    known = Scratch(pages.sparkSession, "revisits").save(known)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.xxhash64("digest") == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.col("url"))

    def line(name: str, *value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))

    def page(c: str) -> F.Column:
        return F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    return rows.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", page("page_id")),
            line("WARC-Date", F.lit(DATE)),
            F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.coalesce(uri, F.lit("")))),
            line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
            F.when(revisit, F.concat(line("WARC-Refers-To", page("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, records_per_file: int = 100_000) -> None:
    writer = records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    writer.mode("overwrite").text(f"{folder}/archives")


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a record head or an HTTP head."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if name}


def scan(source, buffer: int = BUFFER) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, named fields) of the records of an open archive, read front to back."""
    data, base, ended = b"", 0, False  # ``base``: place of data[0] in the file

    def more(least: int) -> None:
        nonlocal data, ended
        while len(data) < least and not ended:
            got = source.read(max(buffer, least - len(data)))
            data, ended = data + got, not got

    while True:
        more(1)
        if not data:
            return
        want = 4096
        while (stop := data.find(b"\r\n\r\n")) < 0:
            more(want)
            if ended and data.find(b"\r\n\r\n") < 0:
                raise OSError(f"no end of the record head at byte {base}")
            want = len(data) + buffer
        fields = headers(data[:stop])
        length = stop + 4 + int(fields["content-length"]) + len(END)
        yield base, length, fields
        if len(data) < length:  # skip the rest of the block
            left = length - len(data)
            data = b""
            while left:
                got = source.read(min(left, buffer))
                if not got:
                    raise OSError(f"the record at byte {base} is cut off")
                left -= len(got)
        else:
            data = data[length:]
        base += length


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """Write and return the index: file, offset, length, url, digest, record_type, page_id, refers_to."""
    st, schema = arrow_schema("file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long")

    def number(uri: str | None) -> int | None:
        text = (uri or "").strip("<>").removeprefix(URN)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(f"{folder}/archives")
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}") as source:
                    for offset, length, h in scan(source):
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append((name, offset, length, h.get("warc-target-uri"), digest, h.get("warc-type"), number(h.get("warc-record-id")), number(h.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(f"{folder}/archives").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    files.filter("length > 0").select("file").mapInArrow(run, st).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(st).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Payload facts of the selected index rows: page_id, url, record_type, refers_to, payload (binary, null for a
    revisit), payload_bytes, payload_digest, intact (does the payload have the digest that its head names?)."""
    places = index.select("file", "offset", "length", "page_id", "url", "record_type", "refers_to")
    st, schema = arrow_schema(
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"
    )

    def parse(data: bytes) -> tuple[bytes | None, int, str | None, bool]:
        head, _, rest = data.partition(b"\r\n\r\n")
        h = headers(head)
        http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
        if h.get("warc-type") == "revisit":
            return None, int(headers(http)["content-length"]), digest, payload == b""
        found = hashlib.sha256(payload).hexdigest()
        return payload, len(payload), found, found == digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = list(zip(*map(parse, batch.column("data").to_pylist()), strict=True))
            if parsed:
                kept = [batch.column(n) for n in ("page_id", "url", "record_type", "refers_to")]
                columns = [*kept, *parsed]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, tuple) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return read_ranges(places, f"{folder}/archives").mapInArrow(run, st)
