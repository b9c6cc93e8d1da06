"""Sharding by rendezvous hashing of stable record keys over weighted shards, in DataFrame expressions only.

Every shard scores every key: a hash of key and shard number, taken as a number u between 0 and 1, gives
``ln(u) / weight``, and the shard of the highest score gets the record. A shard so gets keys in proportion to
its weight; one more shard takes only the keys that it now wins, and a shard that goes (weight 0) gives away
only its own. The shard is a function of the key alone, so placing records shuffles nothing.

Slots number the records of a shard without a gap. They follow a hash of the record (``place``), whose upper
bits cut a shard into buckets: counts of buckets give the first slot of each, and only a bucket is sorted in one
task. Equal records are counted before they are shuffled; beyond COPIES of them each further lot has a place of
its own, so neither a key nor a text that a third of all records share fills a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards of the query, and bytes that a record has besides its text.
SHARDS, OVERHEAD = 40, 16
#: Upper bits of the place that name a bucket, and equal records that have one place.
BUCKET_BITS, COPIES = 12, 1000


def _scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """The score of each shard for a key; a shard of weight 0 scores null."""
    out = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
        out.append(F.log(u) / float(weight) if weight > 0 else F.lit(None).cast("double"))
    return out


def placed(records: DataFrame, key: Column, weights: Sequence[float], grown: float = 1.0) -> DataFrame:
    """records with ``shard``, and ``grown_shard``: the shard if one more of weight ``grown`` stood behind the others.

    The two columns replace columns of their name. Keys of any one type; a null is a key like any other. Equal
    scores go to the shard of the lower number. No row is shuffled.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in [*weights, grown]):
        raise ValueError("weights must not be negative, and one must be above 0")
    *own, more = _scores(key, [*weights, grown])
    best = F.array_max(F.array(*own))
    shard = (F.array_position(F.array(*own), best) - 1).cast("int")
    return records.withColumns({"shard": shard, "grown_shard": F.when(more > best, F.lit(len(weights))).otherwise(shard).cast("int")})


def numbered(records: DataFrame, columns: Sequence[str], carried: Sequence[str] = (), shard: str = "shard") -> DataFrame:
    """The given columns of records, shard and ``slot``: from 0 without a gap within each shard.

    The order is that of ``place``, a hash of ``columns``, then of the columns themselves, so it does not depend on how
    the records are dealt out. Columns in ``carried`` are told by the others. Equal records have consecutive slots
    within lots of COPIES.
    """
    names = [shard, *columns, *carried]
    equal = records.select(*names).groupBy(*names).agg(F.count("*").alias("_n"))
    lots = equal.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    lots = lots.withColumn("_n", F.least(F.col("_n") - F.col("_lot") * COPIES, F.lit(COPIES)))
    lots = lots.withColumn("_place", F.xxhash64(*columns, "_lot")).withColumn("_bucket", F.shiftright("_place", 64 - BUCKET_BITS).cast("int"))
    ahead = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2**BUCKET_BITS rows a shard
    starts = lots.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(shard, "_bucket").orderBy("_place", *columns, "_lot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.col("_before"), F.lit(0))
    spread = lots.withColumn("_before", F.sum("_n").over(inside)).join(starts, [shard, "_bucket"])
    return spread.select(*names, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def written(records: DataFrame, path: str, key: Column, weights: Sequence[float], *, size: Column, file_bytes: int = 128 << 20) -> None:
    """Writes records as Parquet, a folder ``shard=N`` for each shard, in files of about ``file_bytes``.

    A shard's records are dealt by a hash of key and size over as many tasks as its bytes ask for, so that a large
    shard is written by many.
    """
    own = placed(records, key, weights).drop("grown_shard")
    each = own.groupBy("shard").agg(F.sum(size.cast("double")).alias("_bytes")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("_bytes") / file_bytes)).alias("_files"))
    dealt = own.join(F.broadcast(each), "shard").withColumn("_file", F.pmod(F.xxhash64(key, size), F.col("_files")))  # one row a shard
    dealt.repartition("shard", "_file").drop("_file", "_files").write.partitionBy("shard").parquet(path)


def document_shards(documents: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Per row of documents: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: doc_id and the shards decide. Size is that of the text in UTF-8 plus OVERHEAD; a null text has
    no bytes. Rows of one doc_id, null included, share a shard; repeated rows each have a slot; an empty table gives
    an empty one. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    columns = ["doc_id", "size", "text_crc32"]
    out = numbered(placed(rows, F.col("doc_id"), weights), columns, carried=["grown_shard"])
    return out.select(*columns, F.lit("key").alias("law"), "shard", "slot", "grown_shard")
