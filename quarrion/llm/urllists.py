"""Temporal list join: captures against the list entries that were active when they were fetched.

Entries (domain, listed, ts) become validity intervals: an entry that lists a domain holds from its
time until the next entry of that domain. A capture is blocked if an interval of its host or of a
parent domain holds at its fetch time; the longest such domain is reported.

The as-of join cuts time into buckets and works on pairs (domain, bucket): intervals and captures of
a bucket are ordered together, and the last interval before a bucket is carried into it. A host that
has a third of all captures is thus spread over all its buckets. Domains that no entry lists, bare top-level
ones above all, are sifted out before anything is ordered. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
BUCKET = 3600
#: Listed domains (some 50 bytes each) up to which they are broadcast to sift the captures' domains.
MOST_BROADCAST = 1_000_000


#: Begins the names of columns that stand beside those of the captures for the time of a join.
_OWN = "__urllists_"


def host_of(url):
    """The lower-case host of a URL without user and port; null for a null URL, empty if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffixes(host):
    """The host and its parent domains, the longest first."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(domain, since, until): while a domain was listed; until is null if nothing follows.

    Of entries with one domain and time a listing wins. Entries with a null are left out. The next
    entry is looked for in the bucket, then in the next bucket that has one.
    """
    clean = entries.select(F.lower("domain").alias("domain"), F.col("ts"), F.col("listed")).where("domain is not null and ts is not null and listed is not null")
    clean = clean.groupBy("domain", "ts").agg(F.max("listed").alias("listed")).withColumn("bucket", _bucket("ts", bucket))
    firsts = clean.groupBy("domain", "bucket").agg(F.min("ts").alias("first"))
    nexts = firsts.select("domain", "bucket", F.lead("first").over(Window.partitionBy("domain").orderBy("bucket")).alias("following"))
    inside = Window.partitionBy("domain", "bucket").orderBy("ts")
    dated = clean.withColumn("until", F.lead("ts").over(inside)).join(nexts, ["domain", "bucket"])
    return dated.where("listed").select("domain", F.col("ts").alias("since"), F.coalesce("until", "following").alias("until"))


def _bucket(ts: str, bucket: int):
    return F.floor(F.unix_timestamp(ts) / bucket)


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", at: str = "fetched_at", bucket: int = BUCKET) -> DataFrame:
    """captures with host, blocked, matched, since and until.

    An interval holds from since on and before until. A null url or time is not blocked. Columns of
    captures with one of these names are replaced; repeated captures stay. Names that begin with
    ``__urllists_`` are taken.
    """
    added = ("host", "blocked", "matched", "since", "until")
    own = captures.drop(*added).withColumn("host", host_of(F.col(url)))
    asked = own.select("host", F.col(at).cast("timestamp").alias("t")).where("host <> '' and t is not null").distinct()
    listed = intervals(entries, bucket).withColumn("bucket", _bucket("since", bucket))
    known = entries.where("listed").select(F.lower("domain").alias("domain")).distinct()
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    keyed = asked.select("host", "t", F.explode(suffixes(F.col("host"))).alias("domain")).join(known, "domain", "left_semi").withColumn("bucket", _bucket("t", bucket))
    # Last interval that began before each bucket in which something is asked.
    ends = listed.groupBy("domain", "bucket").agg(F.max(F.struct("since", "until")).alias("last"))
    cells = keyed.select("domain", "bucket").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType)).unionByName(ends).groupBy("domain", "bucket").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("domain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("domain", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("held")).where("held is not null")
    nothing = F.lit(None).cast(ends.schema["last"].dataType)
    events = keyed.select("domain", "bucket", "host", "t", nothing.alias("own")).unionByName(
        listed.select("domain", "bucket", F.lit(None).cast("string").alias("host"), F.col("since").alias("t"), F.struct("since", "until").alias("own"))
    )
    so_far = Window.partitionBy("domain", "bucket").orderBy("t", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = events.withColumn("inside", F.last("own", ignorenulls=True).over(so_far)).where("host is not null").join(carried, ["domain", "bucket"], "left")
    hit = F.coalesce("inside", "held")
    holds = latest.select("host", "t", "domain", hit.alias("hit")).where(F.col("hit").isNotNull() & (F.col("hit.until").isNull() | (F.col("t") < F.col("hit.until"))))
    best = holds.groupBy("host", "t").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "hit")).alias("best"))
    found = best.select(F.col("host").alias(f"{_OWN}host"), F.col("t").alias(f"{_OWN}t"), F.col("best.domain").alias("matched"), F.col("best.hit.since").alias("since"), F.col("best.hit.until").alias("until"))
    joined = own.join(found, (own["host"] == found[f"{_OWN}host"]) & (own[at].cast("timestamp") == found[f"{_OWN}t"]), "left").drop(f"{_OWN}host", f"{_OWN}t")
    return joined.withColumn("blocked", F.col("matched").isNotNull())
