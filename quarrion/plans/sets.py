"""Set similarity, families and their fingerprints on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import jaccard
from quarrion.operators import families as P
from quarrion.operators import graph as G
from quarrion.operators import similarity as S
from quarrion.plans.registry import Tables, query
from quarrion.storage import checkpointed

# Nodes are orders, features the parts of all their lines.
_MEMBERS = "SELECT DISTINCT l_orderkey AS node, CAST(l_partkey AS VARCHAR) AS feature FROM lineitem"
_DF = f"SELECT feature, count(*) AS df FROM ({_MEMBERS}) GROUP BY 1"


def _members(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").cast("string").alias("feature")).distinct()


# Nodes are documents, features the words of their whole texts.
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_WORDS = f"SELECT DISTINCT doc_id AS node, unnest(regexp_extract_all(text, '{_WORD}')) AS feature FROM documents"
_WORD_DF = f"SELECT feature, count(*) AS df FROM ({_WORDS}) GROUP BY 1"


def _words(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("node"), F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("feature")).distinct()


def _sets(t: Tables) -> DataFrame:
    return S.feature_sets(t.documents, "doc_id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))


def _links(t: Tables) -> DataFrame:
    """Pairs of nodes for the graph queries: orders' customers linked to the customer of the next order."""
    o = t.orders.select(F.col("o_custkey").alias("l"), (F.col("o_custkey") + F.col("o_orderkey") % 11).alias("r"))
    return o.where("l < r").distinct()


@query(_DF)
def a21_document_frequency(t: Tables) -> DataFrame:
    return S.document_frequency(_members(t))


@query(f"WITH m AS ({_MEMBERS}), d AS ({_DF}), n AS (SELECT count(DISTINCT node) AS n FROM m) SELECT feature, df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf, round(ln(n / df), 9) AS plain FROM d, n")
def a22_idf(t: Tables) -> DataFrame:
    m = _members(t)
    plain = S.idf(m, smooth=False).select("feature", F.round("idf", 9).alias("plain"))
    return S.idf(m).join(plain, "feature").select("feature", "df", F.round("idf", 9).alias("idf"), "plain")


@query("SELECT o_orderstatus AS family, c AS feature FROM (SELECT o_orderstatus, o_orderpriority AS c, count(DISTINCT o_custkey % 7) AS k FROM orders GROUP BY 1, 2) WHERE k = 7")
def a23_common_features(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("family"), (F.col("o_custkey") % 7).alias("node"), F.col("o_orderpriority").alias("feature"))
    from quarrion.operators.relational import common_features

    return common_features(rows, "family", "node", "feature")


@query("SELECT conv_id, CASE WHEN bool_and(contains(text, '.')) THEN 1 ELSE 0 END AS all_have FROM conversations GROUP BY 1")
def a24_shared_by_all(t: Tables) -> DataFrame:
    from quarrion.operators.relational import common_features

    marks = t.conversations.select("conv_id", "turn", F.when(F.contains("text", F.lit(".")), "dot").otherwise("none").alias("feature"))
    common = common_features(marks, "conv_id", "turn", "feature").where("feature = 'dot'")
    return t.conversations.select("conv_id").distinct().join(common, "conv_id", "left").select("conv_id", F.col("feature").isNotNull().cast("int").alias("all_have"))


def _pairs_sql(members: str) -> str:
    return f"WITH m AS MATERIALIZED ({members}), s AS (SELECT node, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.node AS l, b.node AS r, count(*) AS shared FROM m a JOIN m b USING (feature) WHERE a.node < b.node GROUP BY 1, 2) SELECT l, r, shared, x.n AS l_size, y.n AS r_size, round(shared / (x.n + y.n - shared), 9) AS jaccard, round(shared / least(x.n, y.n), 9) AS containment FROM p JOIN s x ON x.node = l JOIN s y ON y.node = r"


_PAIRS, _WORD_PAIRS = _pairs_sql(_MEMBERS), _pairs_sql(_WORDS)


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"jaccard": F.round("jaccard", 9), "containment": F.round("containment", 9)})


@query(_PAIRS + f" WHERE EXISTS (SELECT 1 FROM m a JOIN m b USING (feature) JOIN ({_DF}) d USING (feature) WHERE a.node = l AND b.node = r AND d.df <= 24)")
def j13_capped_pairs(t: Tables) -> DataFrame:
    return _rounded(S.pair_overlaps(_members(t), most_df=24))


@query(f"SELECT l, r, shared, l_size, r_size, jaccard FROM ({_PAIRS} WHERE shared > 0.5 * (x.n + y.n - shared))")
def j14_size_pruned_pairs(t: Tables) -> DataFrame:
    """Orders of which more than half of the parts are shared."""
    return S.short_pairs_above(_members(t), 0.5, strict=True).withColumn("jaccard", F.round("jaccard", 9))


def _cosines_sql(members: str) -> str:
    return f"WITH m AS MATERIALIZED ({members}), d AS (SELECT feature, count(*) AS df FROM m GROUP BY 1), n AS (SELECT count(DISTINCT node) AS n FROM m), w AS (SELECT feature, power(ln((n + 1) / (df + 1)) + 1, 2) AS w FROM d, n), q AS (SELECT node, sqrt(sum(w)) AS q FROM m JOIN w USING (feature) GROUP BY 1), p AS (SELECT a.node AS l, b.node AS r, count(*) AS shared, sum(w) AS dot FROM m a JOIN m b USING (feature) JOIN w USING (feature) WHERE a.node < b.node GROUP BY 1, 2) SELECT l, r, shared, round(dot / (x.q * y.q), 8) AS cosine FROM p JOIN q x ON x.node = l JOIN q y ON y.node = r"


def _cosines(members: DataFrame, least: float, rated=S.cosines_above) -> DataFrame:
    """Pairs from just below the least cosine on, so that rounding decides alike; the rounded ones at or above it."""
    found = rated(members, S.idf(members), least - 1e-6).withColumn("cosine", F.round("cosine", 8))
    return found.where(F.col("cosine") >= least)


@query(f"SELECT * FROM ({_cosines_sql(_MEMBERS)}) WHERE cosine >= 0.35")
def j15_weighted_products(t: Tables) -> DataFrame:
    return _cosines(_members(t), 0.35, S.short_cosines_above)


@query(f"SELECT * FROM ({_cosines_sql(_WORDS)}) WHERE cosine >= 0.75 AND shared >= 3")
def f33_cosine_links(t: Tables) -> DataFrame:
    return _cosines(_words(t), 0.75).where("shared >= 3")


@query("SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS sim FROM (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(text, '\\s', ' ', 'g'), ' '), lambda x: x <> '')) AS a, ['the', 'de', 'of'] AS b FROM documents)")
def f32_jaccard(t: Tables) -> DataFrame:
    """Likeness of the words of whole texts to three words; the words are a column of their own, so that a text is split once."""
    words = t.documents.select("doc_id", F.array_remove(F.split("text", "[ \\t\\n\\f\\r]+"), "").alias("words"))
    return words.select("doc_id", jaccard(F.col("words"), F.array(*map(F.lit, ("the", "de", "of"))), 1.0).alias("sim"))


@query(f"SELECT l, r FROM ({_PAIRS}) WHERE jaccard > 0.8")
def f34_thresholded_pairs(t: Tables) -> DataFrame:
    return S.short_pairs_above(_members(t), 0.8, strict=True).select("l", "r")


@query(f"SELECT l, r, shared, jaccard FROM ({_WORD_PAIRS}) WHERE shared > 0.8 * (l_size + r_size - shared)")
def f34_document_pairs(t: Tables) -> DataFrame:
    """Documents of which more than 0.8 of all words are shared."""
    return S.set_pairs_above(_sets(t), 0.8, strict=True).select("l", "r", "shared", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH m AS ({_MEMBERS}), n AS (SELECT count(DISTINCT node) AS n FROM m) SELECT m.node, m.feature, d.df FROM m JOIN ({_DF}) d USING (feature), n WHERE df BETWEEN 2 AND greatest(2, floor(0.12 * n))")
def g03_frequent_features(t: Tables) -> DataFrame:
    """Parts of two orders or more, and of at most 12 of a hundred."""
    m = _members(t)
    n = m.select("node").distinct().count()
    return S.frequent(m, 2, max(2, math.floor(0.12 * n)))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS l, o_custkey + o_orderkey % 11 AS r FROM orders WHERE o_orderkey % 11 > 0), b AS (SELECT l, r FROM e UNION SELECT r, l FROM e), w AS (SELECT DISTINCT l AS node, l AS seen FROM b UNION SELECT w.node, b.r FROM w JOIN b ON b.l = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY 1""")
def g08_components(t: Tables) -> DataFrame:
    return G.components(_links(t), "l", "r")


@query()
def g09_two_core(t: Tables) -> DataFrame:
    return G.k_core(_links(t), 2, "l", "r")


@query()
def g18_linkage_families(t: Tables) -> DataFrame:
    """Medoids of the documents' clusters of complete linkage at 0.8."""
    sets = _sets(t)
    pairs = checkpointed(S.class_pairs_above(sets, 0.8, strict=True))
    found = checkpointed(S.set_families(sets, 0.8, strict=True, pairs=pairs))
    least = checkpointed(found.groupBy("cls", "family").agg(F.min("node").alias("node"), F.count("*").alias("copies")))
    named = lambda side: least.select(F.col("cls").alias(side), F.col("node").alias(f"{side}_node"))
    links = pairs.join(named("l"), "l").join(named("r"), "r").select(F.col("l_node").alias("l"), F.col("r_node").alias("r"), "jaccard")
    alone = least.where("copies > 1").select(F.col("node").alias("l"), F.col("node").alias("r"), F.lit(1.0).alias("jaccard"))
    clusters = S.linkage_clusters(links.unionByName(alone), least.select("node", "family", "copies"), cut=0.2)
    return S.medoids(clusters, least=2)


def _components_sql(least: float) -> str:
    return f"WITH RECURSIVE e AS (SELECT l, r FROM ({_WORD_PAIRS}) WHERE shared > {least} * (l_size + r_size - shared)), b AS (SELECT l, r FROM e UNION SELECT r, l FROM e), w AS (SELECT DISTINCT l AS node, l AS seen FROM b UNION SELECT w.node, b.r FROM w JOIN b ON b.l = w.seen), c AS (SELECT node, min(seen) AS family FROM w GROUP BY 1)"


@query(_components_sql(0.9) + " SELECT node, family, count(*) OVER (PARTITION BY family) AS size FROM c")
def g19_similarity_families(t: Tables) -> DataFrame:
    return S.set_families(_sets(t), 0.9, strict=True).select("node", "family", "size")


@query()
def g17_staged_families(t: Tables) -> DataFrame:
    """Documents by their words; what is left over by the words in small letters without their ends."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    bare = F.filter(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[.,;:!?*#%&$]+$", "")), lambda w: w != "")
    return S.staged_families([("words", _sets(t)), ("bare", S.feature_sets(t.documents, "doc_id", bare))], 0.8)


@query(_components_sql(0.8) + f", k AS (SELECT family, count(*) AS size FROM c GROUP BY 1), f AS (SELECT family, feature, count(*) AS has FROM c JOIN ({_WORDS}) USING (node) GROUP BY 1, 2) SELECT family, list_slice(list(feature ORDER BY df, feature), 1, 20) AS fingerprint FROM f JOIN k USING (family) JOIN ({_WORD_DF}) USING (feature) WHERE has = size GROUP BY 1")
def g15_ordered_fingerprints(t: Tables) -> DataFrame:
    sets = _sets(t)
    words = t.documents.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("feature"))
    return S.fingerprints(S.set_families(sets, 0.8, strict=True), sets, words)


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, source")
def g20_candidates(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n >= 5").orderBy(F.desc("n"), "source")


@query("SELECT md5(text) AS digest, min(doc_id) AS app, count(*) AS tasks FROM documents GROUP BY 1")
def g01_apps_by_digest(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("app"), F.count("*").alias("tasks"))


@query("SELECT strategy, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'grams' WHEN 'de' THEN 'pages' ELSE 'components' END AS strategy FROM documents) GROUP BY 1 ORDER BY 1")
def g02_strategy_routing(t: Tables) -> DataFrame:
    strategy = F.when(F.col("lang") == "en", "grams").when(F.col("lang") == "de", "pages").otherwise("components")
    return t.documents.groupBy(strategy.alias("strategy")).agg(F.count("*").alias("n")).orderBy("strategy")


def _any_start(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


_FINGERPRINTS = "SELECT o_custkey AS app, CASE o_orderkey % 4 WHEN 0 THEN 'F:' || CASE WHEN o_orderkey % 3 > 0 THEN 'com.google.' ELSE 'shop.' END || 'A' WHEN 1 THEN 'S:x.MainActivity' WHEN 2 THEN 'L:Order' || o_orderkey ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'H:org.shop' ELSE 'F:com.google.B' END END AS f FROM orders WHERE o_orderkey % 2 = o_custkey % 2"


@query(f"WITH p AS ({_FINGERPRINTS}) SELECT app, bool_or(starts_with(f, 'H:') OR (starts_with(f, 'F:') AND NOT {_any_start('substr(f, 3)', P.SDK_PREFIXES)})) OR count(DISTINCT f) FILTER (left(f, 2) IN ('S:', 'L:') AND string_split(substr(f, 3), '.')[-1] NOT IN ({', '.join(repr(g) for g in P.GENERIC_NAMES)})) >= 2 AS enough FROM p GROUP BY 1")
def g13_sufficient(t: Tables) -> DataFrame:
    """Whether the features of a customer's orders are enough for a fingerprint."""
    k = F.col("o_orderkey")
    whole = F.when(k % 3 > 0, "F:com.google.A").otherwise("F:shop.A")
    f = F.when(k % 4 == 0, whole).when(k % 4 == 1, "S:x.MainActivity").when(k % 4 == 2, F.concat(F.lit("L:Order"), k.cast("string"))).otherwise(F.when(k % 5 == 0, "H:org.shop").otherwise("F:com.google.B"))
    found = t.orders.where("o_orderkey % 2 = o_custkey % 2").groupBy(F.col("o_custkey").alias("app")).agg(F.collect_set(f).alias("f"))
    return found.select("app", P.is_sufficient(F.col("f")).alias("enough"))
