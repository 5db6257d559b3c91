"""WARC archives: written and read with Spark's text source, and revisits resolved by payload digest.

A record ends where the next one's version line begins, so the text source can read archives with that line as separator, in
many tasks where files aren't compressed. Whether a payload holds such a line itself is seen from the declared lengths.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 0
# Fixed values of the format (WARC 1.1, RFC 4648).
VERSION, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Base32 of the payload's SHA-1, without a prefix."""
    hexed = F.sha1(payload)
    # 40 bits a time are 8 digits of base 32, which conv writes as 0-9 and A-V.
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records_of(pages: DataFrame) -> DataFrame:
    """A response for every page: page_id, target_uri, date, record_id, record_type, refers_to (all headers), payload.

    A null html is an empty payload; a null page_id or url leaves its header out; line ends in a url are percent-encoded.
    """
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), uri.alias("target_uri"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )


def record_text(records: DataFrame) -> DataFrame:
    """``value``: each record with fresh headers. A revisit has the headers of its payload, but not its bytes."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    lines = [
        line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("Page-Id", F.col("page_id").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    return records.select(F.concat(F.lit(VERSION), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"), http, body).alias("value"))


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records, each followed by two line ends, in as many files as there are partitions. With ``none`` many tasks can read a file."""
    record_text(records).write.option("lineSep", BREAK).option("compression", compression).text(path)


def _head(value: Column) -> Column:
    return F.substring_index(value, BREAK, 1)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*<?([^\r\n]*?)>?[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _needed(value: Column) -> Column:
    """Bytes that the record at the start of a piece takes by its own headers; null if there are none."""
    return F.octet_length(_head(value)) + F.lit(2 * len(BREAK)) + _field(_head(value), "Content-Length").try_cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines: file, block, place, value. Pieces of a file are in the order of (block, place)."""
    text = spark.read.option("lineSep", VERSION).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, with the headers that ``records_of`` names, payload_digest as declared, payload_bytes and payload.

    The payload of a revisit is null. Payloads may hold anything, whole records too: a piece that isn't as long as its headers say
    is joined with those that follow it in its file, as one task a file works out from the pieces' lengths alone.
    """
    pieces = _pieces(spark, path)
    whole = F.octet_length("value") == _needed(F.col("value"))
    odd = pieces.filter((F.col("value") != "") & ~F.coalesce(whole, F.lit(False))).select("file").distinct()
    if odd.isEmpty():
        return parsed(pieces.filter("value <> ''").select("value"))
    odd = common.written(odd, "warc-odd")

    def joined(of_file: pd.DataFrame) -> pd.DataFrame:
        of_file = of_file.sort_values(["block", "place"])
        record, sizes, needs = [], of_file["size"].tolist(), of_file["need"].tolist()
        left = 0
        for i, (size, need) in enumerate(zip(sizes, needs, strict=True)):
            if left > 0:
                record.append(record[-1])
                left -= size + len(VERSION)
            else:
                record.append(i)
                left = 0 if pd.isna(need) else need - size
        return of_file.assign(record=record)[["file", "block", "place", "record"]]

    lengths = common.sized_join(pieces, odd, ["file"]).select("file", "block", "place", F.octet_length("value").cast("long").alias("size"), _needed(F.col("value")).alias("need"))
    belongs = common.written(lengths.groupBy("file").applyInPandas(joined, "file string, block long, place long, record long"), "warc-joined")
    several = belongs.join(belongs.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["file", "record"])
    placed = pieces.join(several.select("file", "block", "place", "record"), ["file", "block", "place"], "left")
    order = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    long = placed.filter("record IS NOT NULL").groupBy("file", "record").agg(F.array_join(F.transform(order, lambda p: p["value"]), VERSION).alias("value"))
    return parsed(placed.filter("record IS NULL AND value <> ''").select("value").unionByName(long.select("value")))


def parsed(records: DataFrame) -> DataFrame:
    """Headers and payload of the records in ``value``. Records other than responses and revisits have their whole block as payload."""
    head = _head(F.col("value"))
    http = F.coalesce(F.lower(_field(head, "Content-Type")).startswith("application/http"), F.lit(False))
    inner = F.when(http, F.substring_index("value", BREAK, 2)).otherwise(head)
    at, end = F.octet_length(inner) + len(BREAK), F.octet_length("value") - len(BREAK)
    body = F.substring(F.col("value").cast("binary"), at + 1, F.greatest(end - at, F.lit(0)))
    kind = _field(head, "WARC-Type")
    own = records.select(
        _field(head, "Page-Id").try_cast("long").alias("page_id"), _field(head, "WARC-Target-URI").alias("target_uri"), _field(head, "WARC-Date").alias("date"), _field(head, "WARC-Record-ID").alias("record_id"),
        kind.alias("record_type"), _field(head, "WARC-Refers-To").alias("refers_to"), F.regexp_extract(_field(head, "WARC-Payload-Digest"), "([^:]*)$", 1).alias("payload_digest"),
        F.when(kind == "revisit", _field(F.substring(inner, F.length(head), F.length(inner)), "Content-Length").try_cast("long")).alias("__declared"), F.when(kind != "revisit", body).alias("payload"),
    )
    return own.withColumn("payload_bytes", F.coalesce(F.octet_length("payload").cast("long"), "__declared")).drop("__declared")


def resolved(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records with what each shall be: of responses with equal payloads of at least ``least_bytes`` bytes that with the largest
    page_id stays one, the others revisit it; a revisit that the archives had already refers to the response that stays.

    Only headers are shuffled, by payload digest: (SHA-1, bytes, SHA-256), so that no two payloads are taken for one. Of records that tie, the one with the
    largest record_id is the response; a record without a page_id is it only where none has one. A revisit whose payload is nowhere stays as it is.
    """
    full = F.col("payload").isNotNull()
    records = records.withColumns({"payload_digest": F.when(full, payload_digest(F.col("payload"))).otherwise(F.col("payload_digest")), "__sha": F.when(full, F.sha2("payload", 256))})
    large = F.col("payload_bytes") >= least_bytes
    groups = records.filter(full & (F.col("record_type") == "response") & large).groupBy("payload_digest", "payload_bytes", "__sha")
    chosen = groups.agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct("page_id", "record_id")).alias("__keep"))
    # An archive's own revisits have no payload: they meet by what their headers say.
    revisits = records.filter("record_type = 'revisit'").select("payload_digest", "payload_bytes").distinct().withColumn("__asked", F.lit(True))
    chosen = chosen.join(revisits, ["payload_digest", "payload_bytes"], "left").filter("__n > 1 OR __asked")
    chosen = common.written(chosen.select("payload_digest", "payload_bytes", F.col("__sha").alias("__of"), F.col("__keep.record_id").alias("__keep")), "warc-chosen")
    # By the SHA-1 a revisit could mean two payloads; it means the first by SHA-256.
    first = chosen.groupBy("payload_digest", "payload_bytes").agg(F.min_by("__keep", "__of").alias("__first"), F.map_from_entries(F.collect_list(F.struct("__of", "__keep"))).alias("__by"))
    joined = common.sized_join(records, first, ["payload_digest", "payload_bytes"], "left")
    target = F.when(F.col("record_type") == "revisit", F.col("__first")).when((F.col("record_type") == "response") & large, F.try_element_at("__by", F.col("__sha")))
    again = target.isNotNull() & (target != F.col("record_id"))
    out = joined.withColumns({"refers_to": F.when(again, target).otherwise(F.col("refers_to")), "record_type": F.when(again, "revisit").otherwise(F.col("record_type"))})
    return out.select("page_id", "target_uri", "date", "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")


def deduplicated(spark: SparkSession, path: str, to: str, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Read the archives in ``path`` and write them to ``to`` with every payload once."""
    write_archive(resolved(read_archive(spark, path), least_bytes), to, compression)


def looked_up(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of the response) of records read from archives.

    Bytes and digest of a response are measured on its payload, those of a revisit on the payload of the response that it refers to;
    a revisit whose response is in no archive keeps what it declares, and refers to no page.
    """
    measured = F.when(F.col("payload").isNotNull(), payload_digest(F.col("payload"))).otherwise(F.col("payload_digest"))
    headers = common.written(records.select("page_id", "record_id", "record_type", "refers_to", "payload_bytes", measured.alias("payload_digest")), "warc-headers")
    originals = headers.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), *[F.col(c).alias(f"__{c}") for c in ("page_id", "payload_bytes", "payload_digest")])
    revisits = headers.filter("record_type = 'revisit'").join(originals, ["refers_to"], "left")
    both = [F.coalesce(f"__{c}", c).alias(c) for c in ("payload_bytes", "payload_digest")]
    revisits = revisits.select("page_id", *both, "record_type", F.col("__page_id").alias("refers_to"))
    rest = headers.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return rest.unionByName(revisits)


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for every page, deduplicate the archives, and tell what stands in them.

    A null html is an empty payload, and all empty ones are equal. Repeated rows are records of their own: one of them is the response. An empty
    table gives no rows. Columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    raw, out = (f"{common.shared_dir(spark).rstrip('/')}/llm-warc-{kind}-{uuid.uuid4().hex}" for kind in ("raw", "out"))
    records = records_of(pages)
    write_archive(records.withColumns({"payload_digest": payload_digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")}), raw, "snappy")  # read twice, then deleted
    deduplicated(spark, raw, out, least_bytes)
    common.delete(spark, raw)
    found = looked_up(read_archive(spark, out))
    common.delete(spark, out)
    return found


def op12_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(common.read(spark, sf_dir, "pages"))


_BITS = "[('0x' || substr(h, 10 * i + 1, 10))::BIGINT for i in range(4)]"
ORACLE_SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
told AS (SELECT *, array_to_string(flatten([[substr('{BASE32}', ((x >> (35 - 5 * j)) & 31)::INTEGER + 1, 1) for j in range(8)] for x in {_BITS}]), '') AS payload_digest,
                max(page_id) OVER (PARTITION BY payload) AS kept FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM told
"""
