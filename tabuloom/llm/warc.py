"""WARC archives as a table of record chunks.

A record is one or more rows (record id, chunk number, bytes), each written as a WARC segment of its
own: the first as a response with an HTTP head, the others as continuations; a page with the payload of
another is a revisit, the HTTP head alone. Writing and reading are plain text-file jobs with the record's
first line as separator, so archives may lie in any store Spark reaches, and no task holds more of a
record than a chunk when it reads it back: digests are carried along the chunks. Chunks are cut from the
row's payload one after the other as they are written. Compression is that of Spark's text files: a file is
one gzip stream, which readers go through in order; who needs to seek by record writes it uncompressed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabuloom.llm.common import parts, shared_folder

CHUNK_BYTES = 1 << 20
LEAST_REVISIT = 100
#: First line of every record. A payload is cut inside each occurrence, so that no chunk holds one.
VERSION = "WARC/1.1"
EOL = "\r\n"


#: Fixed values of the standard.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"


def typed(pages: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """`pages` (k, url, body) with digest, n_bytes and refers_to, the least key with the same payload.

    Digests and keys alone are compared; payloads are joined by key and digest to what was found of their
    own row, so equal payloads are spread over tasks.
    """
    rows = pages.withColumn("digest", F.sha2("body", 256)).withColumn("n_bytes", F.octet_length("body").cast("long"))
    digests = rows.where(F.col("n_bytes") >= least).select("k", "digest")
    same = digests.groupBy("digest").agg(F.min("k").alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null")
    again = digests.join(same.select("digest", "origin"), "digest").where("k is null or k > origin").groupBy(
        F.col("k").alias("r_k"), F.col("digest").alias("r_digest")).agg(F.min("origin").alias("refers_to"))
    own = (F.col("digest") == F.col("r_digest")) & F.col("k").eqNullSafe(F.col("r_k"))
    return rows.join(again, own, "left").drop("r_k", "r_digest")


def _spans(body: Column, size: int) -> Column:
    """(at, length) of the chunks of a body: pieces of `size` bytes, cut inside each occurrence of the separator; one empty one if empty."""
    def pieces(at: Column, n: Column) -> Column:
        last = F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            (at + i * size).alias("at"), F.least(n - i * size, F.lit(size)).alias("length")))

    text = body.cast("string")
    lengths = F.transform(F.split(text, r"(?<=WARC/1\.)(?=1)", -1), F.octet_length)
    parts = F.aggregate(
        lengths, F.struct(F.lit(0).alias("end"), F.expr("CAST(array() AS array<struct<at:int,length:int>>)").alias("spans")),
        lambda done, n: F.struct((done["end"] + n).alias("end"), F.concat(done["spans"], pieces(done["end"], n)).alias("spans")),
        lambda done: done["spans"])
    return F.when(text.contains(VERSION), parts).otherwise(pieces(F.lit(0), F.octet_length(body)))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)))


def _http(n_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK" + EOL), _field("Content-Type", F.lit("text/html")), _field("Content-Length", n_bytes), F.lit(EOL))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", size: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """(record_id, chunk, chunks, value): the chunk table; value is the WARC record of the chunk without the last line end.

    A page without a URL has `urn:page:` and its key as target.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = typed(rows, "k", "body", least).withColumn("record_id", F.expr("uuid()"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("length")))
    rows = rows.withColumn("spans", F.when(F.col("refers_to").isNotNull(), whole).otherwise(_spans(F.col("body"), size))).withColumn("chunks", F.size("spans"))
    rows = rows.select("k", "u", "digest", "n_bytes", "refers_to", "record_id", "chunks", "body", F.posexplode("spans").alias("chunk", "span"))
    first, many = F.col("chunk") == 0, F.col("chunks") > 1
    http = F.when(first, _http(F.col("n_bytes"))).otherwise(F.lit(""))
    block = F.concat(http.cast("binary"), F.substring("body", F.col("span.at") + 1, F.col("span.length")))
    rows = rows.select("k", "u", "digest", "n_bytes", "refers_to", "record_id", "chunks", "chunk", block.alias("block"),
                       F.when(first, F.col("record_id")).otherwise(F.expr("uuid()")).alias("own_id"))
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(first, "response").otherwise("continuation")
    target = F.coalesce("u", F.concat(F.lit("urn:page:"), F.coalesce(F.col("k").cast("string"), F.lit("null"))))
    address = F.regexp_replace(F.regexp_replace(target, r"[\x00-\x20\x7F]", "%20"), r"WARC/1\.1", "WARC/1%2E1")
    name = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit(VERSION + EOL), _field("WARC-Type", kind), _field("WARC-Record-ID", name("own_id")), _field("WARC-Date", date), _field("WARC-Target-URI", address),
        _field("WARC-Profile", F.when(F.col("refers_to").isNotNull(), IDENTICAL)),
        _field("Content-Type", F.when(first, HTTP)), _field("Content-Length", F.octet_length("block")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Segment-Number", F.when(many, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, name("record_id"))),
        _field("WARC-Segment-Total-Length", F.when(many & (F.col("chunk") == F.col("chunks") - 1), F.col("n_bytes") + F.octet_length(_http(F.col("n_bytes"))))),
        _field("X-Segments", F.col("chunks")), _field("X-Page-ID", F.col("k")), _field("X-Refers-To-Page-ID", F.col("refers_to")), _field("X-Payload-Length", F.col("n_bytes")))
    value = F.concat(head.cast("binary"), F.lit(EOL.encode()), F.col("block"), F.lit(EOL.encode())).cast("string")
    return rows.select("record_id", "chunk", "chunks", value.alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Archives of `pages` in the folder `path`, one file a task."""
    records(pages, **options).select("value").write.option("lineSep", EOL).option("compression", compression).text(path)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(page_id, record_id, chunk, chunks, record_type, refers_to, digest, total, data) per chunk of the archives."""
    raw = spark.read.option("lineSep", VERSION + EOL).text(path).where("value != ''")
    rows = raw.select(F.expr(r"concat('\r\n', substring(value, 1, instr(value, '\r\n\r\n') + 1))").alias("head"), (F.octet_length(F.expr(r"substring(value, 1, instr(value, '\r\n\r\n') - 1)")) + 5).alias("at"), F.col("value").cast("binary").alias("raw"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))

    length = field("Content-Length").cast("int")
    chunk = F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1
    # Of the first chunk the HTTP head goes: the block up to its first empty line.
    blocks = rows.withColumn("http", F.when(chunk == 0, F.octet_length(F.substring_index(F.col("raw").cast("string"), EOL + EOL, 2)) + 5 - F.col("at")).otherwise(F.lit(0)))
    identity = lambda of: F.nullif(F.regexp_extract("head", of + ": <urn:uuid:([0-9a-f-]{36})", 1), F.lit(""))
    return blocks.select(
        field("X-Page-ID").cast(kind).alias("page_id"), F.coalesce(identity("WARC-Segment-Origin-ID"), identity("WARC-Record-ID")).alias("record_id"),
        chunk.alias("chunk"), field("X-Segments").cast("int").alias("chunks"),
        field("WARC-Type").alias("record_type"), field("X-Refers-To-Page-ID").cast(kind).alias("refers_to"),
        F.regexp_extract("head", "WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
        field("X-Payload-Length").cast("long").alias("total"), F.substring("raw", F.col("at") + F.col("http"), length - F.col("http")).alias("data"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of records of several chunks, carried from chunk to chunk in order."""
    record, digest, size, seen = None, hashlib.sha256(), 0, 0
    for batch in batches:
        done = []
        for name, chunks, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if name != record:
                record, digest, size, seen = name, hashlib.sha256(), 0, 0
            piece = data.as_buffer()
            digest.update(piece)
            size, seen = size + piece.size, seen + 1
            if seen == chunks:
                done.append((name, size, digest.hexdigest()))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["record_id", "n_bytes", "own"])


def summary(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record of a chunk table.

    Length and digest of a response are those of the bytes read back, and must be what its header says;
    those of a revisit are its header's. Fails on a record whose chunks are missing or changed.
    """
    whole = chunks.where("chunks = 1").withColumn("n_bytes", F.octet_length("data").cast("long")).withColumn("own", F.sha2("data", 256))
    many = chunks.where("chunks > 1")
    runs = many.select("record_id", "chunk", "chunks", "data").repartition(parts(chunks.sparkSession), "record_id").sortWithinPartitions("record_id", "chunk")
    sizes = runs.mapInArrow(_stream, "record_id string, n_bytes long, own string")
    long = many.where("chunk = chunks - 1").drop("data").join(sizes, "record_id", "left").withColumn("record_type", F.lit("response"))
    columns = ["page_id", "record_type", "refers_to", "digest", "total", "n_bytes", "own"]
    rows = whole.select(columns).unionByName(long.select(columns))
    revisit = F.col("record_type") == "revisit"
    right = revisit | ((F.col("own") == F.col("digest")) & (F.col("n_bytes") == F.col("total")))
    digest = F.when(F.coalesce(right, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("archive differs from its header: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return rows.select("page_id", F.when(revisit, F.col("total")).otherwise(F.col("n_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None, size: int = CHUNK_BYTES, least: int = LEAST_REVISIT, compression: str = "gzip") -> DataFrame:
    """Write a record per row of `pages` under `path` (a new shared folder if none), then read the archives back.

    A null payload is empty; a page without a URL is named by its key. Of equal payloads of at least `least` bytes
    the one with the least key is the response, the others revisit it; rows repeating that key are
    responses all; a null key revisits where another row has one. An empty table gives an empty one; other
    columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[key].dataType.simpleString()
    write(pages, path, compression, key=key, url=url, payload=payload, size=size, least=least)
    return summary(read(spark, path, kind)).withColumnRenamed("page_id", key)
