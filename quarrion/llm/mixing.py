"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Every document gets a rate (copies, not yet whole): the rates nearest to 1 in relative entropy, each
word counting once and no rate above ``most``, with which every source yields its target of words and
the mix keeps the corpus' mean of log document length over words, so that a heavier source does not
bring its lengths along. The dual of this convex problem has a multiplier a source and one for the
shared constraint (with a small ridge, as sources whose documents have one length cannot meet it); the
optimum is an exponential tilt, ``rate = min(most, exp(lambda[source] + mu * x))``. Newton iterations
solve it: each sums gradient and Hessian over the documents (those of one source and size count
together), eliminates the sources' multipliers row by row and brings five sums to the driver for the
shared one. They end at a tolerance.

Rates are rounded into whole copies: all documents get the whole part; an extra copy goes to documents
in the order of a hash of theirs over the rest of their rate, as many as the missing words allow.
Prefix sums are taken in two levels (buckets of a source, then rows of a bucket), so no source has to
be sorted in one task. What the first document beyond the need leaves over is spent in further passes
on documents that still fit, the larger powers of two first. At the end one unit that goes beyond the
need is taken where that is nearer to the target, so a source misses it by half a unit at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.storage import checkpointed

#: Weights by the rank of a source, repeating; words to take as a share of all; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Newton steps at most, relative residual at which they end, largest step of a multiplier, ridge of the shared constraint.
STEPS, TOLERANCE, LONGEST, RIDGE = 40, 1e-7, 1.0, 0.05
#: Buckets of a source, and passes of rounding.
BUCKETS, PASSES = 1024, 4
#: Sources whose table may be broadcast (some 100 bytes each), and salts of a source beyond that.
FEW_SOURCES, SALTS = 20_000, 64

WORD = r"[^\x20\x09-\x0D]+"
#: Begins the names of columns that stand beside those of the documents for the time of a join.
_OWN = "__mixing_"


def units(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, n): rows that agree in these columns count as one unit of n rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def _before(rows: DataFrame, order: list[Column], sums: tuple[str, ...], ranges: int) -> DataFrame:
    """rows with ``before_<c>``, the sum of column c over the rows ahead in the order: within ranges, and over whole ranges (one row each)."""
    if ranges == 1:
        ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # FEW_SOURCES rows at most
        return rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in sums})
    ranged = checkpointed(rows.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").agg(*(F.sum(c).alias(c) for c in sums)).select("_p", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.join(F.broadcast(starts), "_p").withColumns({f"before_{c}": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return own.drop("_p", *(f"_{c}" for c in sums))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size), one a source.

    Sources by code point, null last, take the weights in turn. A target stops at ``most`` times its
    source's size; the excess is shared again by weight, which ends at one common level of words per
    unit of weight.
    """
    sizes = sizes.select("source", "source_size", F.lit(1).alias("one"))
    ranges = max(1, -(-sizes.count() // FEW_SOURCES)) if FEW_SOURCES else 3
    by_name = F.col("source").asc_nulls_last()
    ranked = _before(sizes, [by_name], ("one",), ranges)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")).withColumn("full_at", F.col("cap") / F.col("w"))
    filled = _before(capped, [F.col("full_at"), by_name], ("cap", "w"), ranges)
    total = sizes.agg((F.lit(share) * F.sum("source_size")).alias("total"))
    all_w = capped.agg(F.sum("w").alias("all_w"))
    wanted = filled.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_w)).withColumn("level", (F.col("total") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w")))  # one row each
    wanted = checkpointed(wanted) if ranges > 1 else wanted
    level = wanted.agg(F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level")))["level"].alias("reached"))
    out = wanted.crossJoin(F.broadcast(level))  # one row
    return out.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("reached") * F.col("w")), F.col("cap")).alias("target"))


def balanced(cells: DataFrame, sources: DataFrame, *, most: int = MOST, few: bool = True) -> tuple[DataFrame, float, float, float]:
    """(key, lam) of the sources, and mu, centre and spread of the shared constraint.

    ``cells`` has (key, size, n): n documents of a size; ``sources`` has (key, source_size, target), where a
    target of ``most`` times the size (or none) leaves nothing to solve: lam is null there.
    """
    words, length = F.col("size") * F.col("n"), F.log1p(F.col("size").cast("double"))
    m = cells.agg(F.sum(words).alias("w"), F.sum(words * length).alias("x"), F.sum(words * length * length).alias("x2")).first()
    total = float(m.w or 0)
    if not total:
        return sources.select("key", F.lit(None).cast("double").alias("lam")), 0.0, 0.0, 1.0
    centre = m.x / total
    spread = max(0.0, m.x2 / total - centre**2) ** 0.5
    spread = spread if spread > 1e-6 else 1.0
    free = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    lam = sources.select("key", "target", F.when(free, F.log(F.col("target") / F.col("source_size"))).alias("lam"))
    mu, sums_before = 0.0, None
    for _ in range(STEPS):
        x = (length - centre) / spread
        rate = F.when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") + F.lit(mu) * x)))
        rated = _with_source(cells.where("size > 0"), lam, "size", few).select("key", "target", "lam", x.alias("x"), (words * rate).alias("got"), (F.col("lam").isNotNull() & (rate < most)).cast("double").alias("open"))
        sums = rated.groupBy("key").agg(F.first("target").alias("target"), F.first("lam").alias("lam"), F.sum("got").alias("g"), F.sum(F.col("got") * F.col("open")).alias("h"), F.sum(F.col("got") * F.col("open") * F.col("x")).alias("c"), F.sum(F.col("got") * F.col("open") * F.col("x") * F.col("x")).alias("q"), F.sum(F.col("got") * F.col("x")).alias("shared"))
        gap = F.when(F.col("lam").isNotNull(), F.col("target") - F.col("g")).otherwise(0.0)
        before, sums = sums_before, sums.withColumn("gap", gap).cache()  # a row a source; recomputed where an executor is lost
        r = sums.agg(F.sum("shared").alias("b"), F.sum("q").alias("q"), F.sum(F.try_divide(F.col("c") * F.col("gap"), F.col("h"))).alias("ca"), F.sum(F.try_divide(F.col("c") * F.col("c"), F.col("h"))).alias("cc"), F.max(F.abs("gap") / F.greatest("target", F.lit(1.0))).alias("worst")).first()
        if before is not None:
            before.unpersist()
        sums_before = sums
        pull = -(r.b or 0.0) - RIDGE * total * mu
        spare = max(0.0, (r.q or 0.0) - (r.cc or 0.0))  # spread inside the sources, without which mu changes no rate
        step = max(-LONGEST, min(LONGEST, (pull - (r.ca or 0.0)) / (spare + RIDGE * total))) if spare > 1e-9 * total else 0.0
        if (r.worst or 0.0) <= TOLERANCE and abs(step) * (spare / total) ** 0.5 <= TOLERANCE:
            break
        move = F.try_divide(F.col("gap") - F.col("c") * F.lit(step), F.col("h"))
        lam = sums.select("key", "target", (F.col("lam") + F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), F.coalesce(move, F.lit(0.0))))).alias("lam"))
        mu += step
    return lam.select("key", "lam"), mu, centre, spread


def _with_source(rows: DataFrame, sources: DataFrame, spread: str, few: bool, how: str = "inner") -> DataFrame:
    """rows joined to a table of one row a source by key.

    The table is broadcast if it has few rows; otherwise it is repeated for every salt, so a source with
    a large part of all rows is dealt over SALTS tasks. ``spread`` is the column that gives the salt.
    """
    if few:
        return rows.join(F.broadcast(sources), "key", how)
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], how).drop("salt")


def _spend(rows: DataFrame, need: DataFrame, most: int, large_first: bool, few: bool) -> DataFrame:
    """rows with one more extra copy where the missing words (key, need) reach.

    The first pass goes by ``turn``, the hash over the rest of the rate, later ones by size and hash. Rows
    without words, beyond the need or with most copies are passed over.
    """
    if large_first:
        bucket, order = F.pmod("hash", F.lit(BUCKETS)) - F.floor(F.log2(F.greatest("words", F.lit(1)))) * BUCKETS, ["hash", "doc_id", "size"]
    else:  # a turn beyond 2 has few copies to hope for, but a source may consist of such: they are spread by its logarithm
        by_turn = F.when(F.col("turn") < 2, F.floor(F.col("turn") * (BUCKETS // 2))).otherwise(BUCKETS + F.floor((F.log2("turn") - 1) * (BUCKETS // 4)))
        bucket, order = F.when(F.col("can"), by_turn).otherwise(F.pmod("hash", F.lit(BUCKETS))), ["turn", "hash", "doc_id", "size"]
    can = (F.col("base") + F.col("extra") < most) & (F.col("words") > 0) & (F.col("words") <= F.col("need"))
    open_rows = _with_source(rows, need, "hash", few).withColumn("can", can).withColumn("bucket", bucket.cast("long"))
    words = F.when(F.col("can"), F.col("words")).otherwise(0)
    sums = open_rows.groupBy("key", "bucket").agg(F.sum(words).alias("sum"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # some thousand rows a source: BUCKETS times the powers of two of turns or sizes at most
    starts = sums.select("key", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = open_rows.join(starts, ["key", "bucket"]).withColumn("upto", F.col("start") + F.sum(words).over(inside))
    taken = F.col("extra") + F.when(F.col("can") & (F.col("upto") <= F.col("need")), 1).otherwise(0)
    return summed.select("key", "hash", "turn", "doc_id", "source", "size", "n", "words", "base", "target", "source_size", taken.alias("extra"))


def _missing(rows: DataFrame):
    """(key, need): the words that a source still lacks, one row a source."""
    got = rows.groupBy("key").agg(F.sum(F.col("words") * (F.col("base") + F.col("extra"))).alias("got"), F.first("target").alias("target"))
    return got.select("key", (F.col("target") - F.col("got")).alias("need"))


def _nearest(rows: DataFrame, most: int, few: bool) -> DataFrame:
    """rows with one more extra copy a source, of the least unit beyond the missing words, where that leads nearer to the target."""
    may = (F.col("base") + F.col("extra") < most) & (F.col("words") > F.col("need")) & (F.col("words") < 2 * F.col("need"))
    least = _with_source(rows, _missing(rows), "hash", few).where(may).groupBy("key").agg(F.min(F.struct("words", "hash", "doc_id", "size")).alias("pick"))
    picked = F.struct("words", "hash", "doc_id", "size").eqNullSafe(F.col("pick"))
    return _with_source(rows, least, "hash", few, "left").withColumn("extra", F.col("extra") + F.when(picked, 1).otherwise(0)).drop("pick")


def copies(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies) of the units of documents.

    Null texts have size 0, a null source is a source, null ids are allowed. Documents without words
    get the whole part of their rate. Reruns agree: the order is a hash of id and size.
    """
    all_units = checkpointed(units(documents))
    cells = checkpointed(all_units.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source is a source too
    rated = checkpointed(targets(sizes, weights=weights, share=share, most=most).withColumn("key", named))
    few = rated.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    lam, mu, centre, spread = balanced(cells.select(named.alias("key"), "size", "n"), rated, most=most, few=few)
    rated = rated.drop("source").join(lam, "key", "left")
    x = (F.log1p(F.col("size").cast("double")) - centre) / spread
    tilted = F.least(F.lit(float(most)), F.exp(F.col("lam") + F.lit(mu) * x))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("source_size") <= 0, 0.0).when(full, float(most)).otherwise(F.round(F.coalesce(tilted, F.lit(0.0)), 9))
    keyed = _with_source(all_units.withColumn("key", named), rated, "doc_id", few).withColumns({"rate": rate, "hash": F.xxhash64("doc_id", "size")})
    base = F.floor("rate").cast("int")
    turn = (F.pmod("hash", F.lit(1 << 30)) + 0.5) / (1 << 30) / F.greatest(F.col("rate") - base, F.lit(1e-9))
    rows = checkpointed(keyed.select("key", "hash", turn.alias("turn"), "doc_id", "source", "size", "n", (F.col("size") * F.col("n")).alias("words"), base.alias("base"), "target", "source_size", F.lit(0).alias("extra")))
    for number in range(PASSES):
        rows = checkpointed(_spend(rows, _missing(rows).withColumn("need", F.col("need") + 0.5), most, large_first=number > 0, few=few))
    rows = _nearest(rows, most, few)
    return rows.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies"))


def mixture(documents: DataFrame, **options) -> DataFrame:
    """Per row of documents: doc_id, size, source_size, target and the words taken (repeats counted)."""
    found = copies(documents, **options)
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and the number of their copies.

    A document without words has nothing to take and stays out. The new column is ``copies``; a
    column of that name in documents is replaced. Names that begin with ``__mixing_`` are taken.
    """
    found = copies(documents, **options).where("copies > 0 and size > 0").select(*(F.col(c).alias(f"{_OWN}{c}") for c in ("doc_id", "source", "size", "copies")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = documents.drop("copies").select("*", F.col("doc_id").cast("long").alias(f"{_OWN}i"), F.col("source").cast("string").alias(f"{_OWN}s"), size.alias(f"{_OWN}w"))
    same = F.col(f"{_OWN}i").eqNullSafe(F.col(f"{_OWN}doc_id")) & F.col(f"{_OWN}s").eqNullSafe(F.col(f"{_OWN}source")) & (F.col(f"{_OWN}w") == F.col(f"{_OWN}size"))
    return own.join(found, same).select(*(F.col(f"`{c}`") for c in documents.columns if c != "copies"), F.col(f"{_OWN}copies").alias("copies"))
