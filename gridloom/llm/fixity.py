"""Merkle fixity audit of WARC records.

Records lie in archives, in order, at offsets.  Each archive's records are the leaves of
a tree over ordered offset ranges: an inner node covers ``FANOUT`` consecutive children,
and its hash is the SHA-256 of their hashes in order.  A root also covers the
archive's number of records and bytes.  Two replicas' roots are compared; below a
mismatch only mismatching nodes' children are joined, level by level, so an audit of
intact replicas touches roots only, and one corrupt record costs ``FANOUT`` hashes a
level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

FANOUT = 16
#: Records in an archive of ``warc_records``.
ARCHIVE = 1000
SPARE = 4096


def warc_records(pages: DataFrame, per_archive: int = ARCHIVE) -> DataFrame:
    """(archive, ordinal, offset, length, page_id, record): WARC/1.0 response records of the pages.

    Pages are put into archives by ``page_id div per_archive``, ordered by page_id (ties:
    url, html).  Null url and html are empty; rows without a page_id are dealt to ``SPARE``
    archives below 0 by a hash, so that many of them are no single task.
    Other columns are ignored.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")
    rows = pages.select(F.coalesce(F.floor(F.col("page_id") / per_archive).cast("long"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(SPARE))).cast("long").alias("archive"), F.col("page_id").cast("long").alias("page_id"), record.alias("record")).withColumn("length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("archive").orderBy("page_id", "record")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("archive", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), F.coalesce(before, F.lit(0).cast("long")).alias("offset"), "length", "page_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """A record's hash covers its place, so that moved records are found too."""
    place = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.sha2("record", 256))
    return records.select("archive", "ordinal", "offset", "length", "page_id", F.sha2("record", 256).alias("digest"), F.sha2(place.cast("binary"), 256).alias("hash"))


def tree(leaf: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (archive, at, hash), leaves first; the last has one node an archive."""
    level = scratch.keep(leaf.select("archive", F.col("ordinal").alias("at"), "hash"))
    out = [level]
    top = level.agg(F.max("at")).first()[0] or 0
    while top > 0:
        level = level.groupBy("archive", F.floor(F.col("at") / fanout).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("below"))
        level = scratch.keep(level.select("archive", "at", F.sha2(F.array_join(F.transform("below", lambda x: x["hash"]), "").cast("binary"), 256).alias("hash")))
        out.append(level)
        top //= fanout
    return out


def audit(one: DataFrame, other: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> DataFrame:
    """(archive, at): leaves whose hashes differ or that one replica lacks, found by descent from the roots."""
    a, b = tree(one, scratch, fanout), tree(other, scratch, fanout)
    while len(a) != len(b):  # the smaller replica's trees get taller roots
        short = a if len(a) < len(b) else b
        short.append(scratch.keep(short[-1].select("archive", "at", F.sha2(F.col("hash").cast("binary"), 256).alias("hash"))))
    wrong = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if wrong is not None:
            parent = ["archive", F.floor(F.col("at") / fanout).cast("long").alias("up")]
            x, y = (z.select(*parent, "at", "hash").join(wrong.withColumnRenamed("at", "up"), ["archive", "up"], "left_semi") for z in (x, y))
        pair = x.select("archive", "at", F.col("hash").alias("h1")).join(y.select("archive", "at", F.col("hash").alias("h2")), ["archive", "at"], "full_outer")
        wrong = scratch.keep(pair.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("archive", "at"))
    return wrong


def roots(leaf: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> DataFrame:
    """(archive, records, bytes, root): the root over the tree, the number of records and of bytes."""
    top = tree(leaf, scratch, fanout)[-1]
    sizes = leaf.groupBy("archive").agg(F.count("*").alias("records"), F.sum("length").alias("bytes"))
    whole = F.concat_ws(":", F.col("records").cast("string"), F.col("bytes").cast("string"), F.col("hash"))
    return sizes.join(top, "archive").select("archive", "records", "bytes", F.sha2(whole.cast("binary"), 256).alias("root"))


def fixity(records: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, ordinal, offset, length, page_id, digest, intact), one row a record of ``records``.

    Records that only the replica has come with its offset, length, page_id and digest,
    not intact.  An empty replica makes every record not intact.
    """
    scratch = Scratch(records.sparkSession, "fixity")
    one, other = scratch.keep(leaves(records)), scratch.keep(leaves(replica))
    wrong = audit(one, other, scratch, fanout).withColumnRenamed("at", "ordinal").withColumn("wrong", F.lit(True))
    columns = ["archive", "ordinal", "offset", "length", "page_id", "digest"]
    extra = other.select(columns).join(wrong, ["archive", "ordinal"]).join(one.select("archive", "ordinal"), ["archive", "ordinal"], "left_anti")
    out = one.select(columns).join(wrong, ["archive", "ordinal"], "left").union(extra.select(*columns, "wrong"))
    return out.select(*columns, F.col("wrong").isNull().alias("intact"))


def flipped(records: DataFrame, hit: Column) -> DataFrame:
    """A replica in which the records that ``hit`` holds for have one byte changed, in the middle."""
    at = F.floor(F.col("length") / 2).cast("int")
    text = F.hex("record")
    changed = F.unhex(F.concat(F.substr(text, F.lit(1), at * 2), F.when(F.substr(text, at * 2 + 1, F.lit(2)) == "58", "59").otherwise("58"), F.substr(text, at * 2 + 3)))
    return records.withColumn("record", F.when(F.coalesce(hit, F.lit(False)), changed).otherwise(F.col("record")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica in which every record with page_id mod 97 = 13 has rotted."""
    scratch = Scratch(spark, "warc")
    records = scratch.keep(warc_records(table(spark, sf_dir, "pages")))  # else both replicas shuffle the pages
    out = fixity(records, flipped(records, F.col("page_id") % 97 == 13))
    scratch.drop(records)  # the result reads the leaves, which are written
    return out


SQL = f"""
WITH r AS (
  SELECT page_id // {ARCHIVE} AS archive, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages)
SELECT CAST(archive AS BIGINT) AS archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY page_id, record) - 1 AS BIGINT) AS ordinal,
  CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(strlen(record) AS BIGINT) AS length, page_id, sha256(record) AS digest, page_id % 97 <> 13 AS intact FROM r
"""
