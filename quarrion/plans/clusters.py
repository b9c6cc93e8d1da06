"""Families of pages by the links of their menus: component clustering on the driver tables.

A page stands for an application: its host, turned round, is the package, the links of its menu are components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import stem
from quarrion.operators import families as P
from quarrion.operators import libraries as B
from quarrion.operators import similarity as S
from quarrion.plans.registry import Tables, query
from quarrion.storage import checkpointed


def _apps(t: Tables) -> DataFrame:
    """(node, package, components) of the pages."""
    host = F.regexp_extract("url", "://([^/:?#]*)", 1)
    leaves = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    components = F.array_join(F.transform(leaves, lambda x: F.concat(F.lit("."), x)), " ")
    return t.pages.select(F.col("page_id").alias("node"), F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("package"), components.alias("components"))


def _members(t: Tables) -> tuple[DataFrame, int]:
    apps = _apps(t)
    n = apps.count()
    return P.bounded(P.second_features(apps), n), n


_RANDOM = "CASE WHEN regexp_matches(lower(s), '^[0-9a-z]{6,}$') AND (regexp_matches(s, '[0-9]') OR length(regexp_replace(lower(s), '[^aeiou]', '', 'g')) < 0.28 * length(s) OR regexp_matches(lower(s), '[bcdfghjklmnpqrstvwxyz]{5}')) THEN '*' ELSE s END"
_NAMES = """name AS (
  SELECT DISTINCT page_id AS node, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/:?#]*)', 1), '.')), '.') || '.' || leaf AS name
  FROM (SELECT page_id, url, regexp_extract(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)), '^[^\\s,;]*') AS leaf FROM pages)
), part AS (
  SELECT node, name, string_split(name, '.') AS p FROM name WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_$.]*$') AND NOT contains(lower(name), '.permission.') AND NOT contains(lower(string_split(name, '.')[-1]), 'permission')
    AND NOT (length(string_split(name, '.')[-1]) > 2 AND regexp_matches(string_split(name, '.')[-1], '[A-Z]') AND NOT regexp_matches(string_split(name, '.')[-1], '[a-z]'))
)"""
_FEATURES = f"""{_NAMES}, f AS (
  SELECT DISTINCT node, 'H:' || array_to_string(list_transform(list_slice(p, 1, CASE WHEN len(p) > 3 THEN 3 ELSE len(p) - 1 END), lambda s: {_RANDOM}), '.') AS feature FROM part
  UNION SELECT node, 'S:' || p[-2] || '.' || p[-1] FROM part UNION SELECT node, 'L:' || p[-1] FROM part
), n AS (SELECT count(*) AS n FROM pages), m AS (
  SELECT node, feature, df, ln(n / df) AS w FROM f JOIN (SELECT feature, count(*) AS df FROM f GROUP BY 1) USING (feature), n
  WHERE df >= 5 AND df <= CASE WHEN feature LIKE 'H:%' THEN 0.2 ELSE 0.8 END * n
)"""
_PAIRS = f"""{_FEATURES}, norm AS (SELECT node, sqrt(sum(w * w)) AS q FROM m GROUP BY 1), both_have AS (
  SELECT a.node AS l, b.node AS r, feature, a.w, a.df FROM m a JOIN m b USING (feature) WHERE a.node < b.node
), fork AS (
  SELECT l, r, sum(k) AS suffixes, max(k) AS top FROM (SELECT l, r, string_split(substr(feature, 3), '.')[1] AS space, count(*) AS k FROM both_have WHERE feature LIKE 'S:%' GROUP BY 1, 2, 3) GROUP BY 1, 2
), pair AS (
  SELECT l, r, count(*) AS shared, coalesce(sum(w * w) / nullif(any_value(x.q * y.q), 0), 0) AS cosine, count(*) FILTER (WHERE feature LIKE 'H:%' AND df <= 0.06 * n) AS anchors
  FROM both_have JOIN norm x ON x.node = l JOIN norm y ON y.node = r, n GROUP BY 1, 2
)
SELECT l, r, shared, round(cosine, 8) AS cosine, anchors FROM pair LEFT JOIN fork USING (l, r)
WHERE (anchors >= 2 AND cosine >= 0.35) OR (anchors >= 1 AND cosine >= 0.55) OR (shared >= 3 AND cosine >= 0.75) OR (suffixes >= 10 AND top >= 10 AND top >= 0.6 * suffixes)"""


@query(f"WITH {_FEATURES} SELECT node, feature, df, round(w, 9) AS weight FROM m")
def g04_component_features(t: Tables) -> DataFrame:
    members, _ = _members(t)
    return members.select("node", "feature", "df", F.round("weight", 9).alias("weight"))


@query()
def g05_first_rule_links(t: Tables) -> DataFrame:
    apps = _apps(t)
    n = apps.count()
    nodes = t.pages.select(F.col("page_id").alias("node"), stem(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("stem"), F.regexp_extract_all("url", F.lit("://[^/]*/([a-z]+)/"), F.lit(1)).alias("libraries"))
    return P.first_links(P.bounded(P.first_features(apps), n, second=False), n, nodes).select("l", "r", "shared", F.round("cosine", 8).alias("cosine"), "anchors")


@query("WITH " + _PAIRS)
def g06_second_rule_links(t: Tables) -> DataFrame:
    return P.second_links(*_members(t)).select("l", "r", "shared", F.round("cosine", 8).alias("cosine"), "anchors")


def _menus(t: Tables) -> DataFrame:
    return S.features(t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links")), "page_id", "links")


_STAGED = """WITH f AS (SELECT DISTINCT page_id AS node, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS feature FROM pages), s AS (SELECT node, count(*) AS k FROM f GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT node, feature, k FROM f JOIN s USING (node)), n AS (SELECT count(*) AS n FROM s), d AS (SELECT feature, power(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 2) AS w FROM m, n GROUP BY 1),
q AS (SELECT node, sqrt(sum(w)) AS q FROM m JOIN d USING (feature) GROUP BY 1),
p AS (SELECT a.node AS l, b.node AS r, count(*) AS shared, any_value(a.k) AS lk, any_value(b.k) AS rk, sum(w) AS dot FROM m a JOIN m b USING (feature) JOIN d USING (feature) WHERE a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT l, r, shared, round(dot / (x.q * y.q), 8) AS cosine FROM p JOIN q x ON x.node = l JOIN q y ON y.node = r
WHERE shared = lk + rk - shared OR dot / (x.q * y.q) >= 0.82 OR (shared / (lk + rk - shared) >= 0.55 AND shared / least(lk, rk) >= 0.7)"""


@query(_STAGED)
def g07_similar_menus(t: Tables) -> DataFrame:
    return P.staged_links(_menus(t)).select("l", "r", "shared", F.round("cosine", 8).alias("cosine"))


def _groups(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    members, n = _members(t)
    members = checkpointed(members)
    core = checkpointed(P.core_links(*P.second_class_links(members, n)))
    return checkpointed(P.strict_groups(core, members)), members, n


@query()
def g10_strict_component_groups(t: Tables) -> DataFrame:
    return _groups(t)[0]


@query()
def g11_merged_families(t: Tables) -> DataFrame:
    groups, members, _ = _groups(t)
    return P.after_merge(groups, P.merged_groups(groups, members))


@query()
def g14_divided_again(t: Tables) -> DataFrame:
    """Every family is treated as a weak one."""
    groups, members, n = _groups(t)
    return P.divided_again(groups.select("family", "node"), members, n)


@query()
def g16_component_families(t: Tables) -> DataFrame:
    found = P.component_families(_apps(t))
    size = found.members.groupBy("family", "stage").agg(F.count("*").alias("size"))
    return size.join(found.fingerprints, "family").select("family", "stage", "size", "fingerprint")


@query()
def g16_run_counts(t: Tables) -> DataFrame:
    counts = P.component_families(_apps(t)).counts
    return t.spark.createDataFrame(sorted(counts.items()), "name string, n long")


@query()
def g22_broken_fingerprints(t: Tables) -> DataFrame:
    """(family, feature) of fingerprints that a member of the family lacks: none."""
    apps = _apps(t)
    found = P.component_families(apps)
    return P.broken_fingerprints(found.members, found.fingerprints, P.second_features(apps))


@query("SELECT n_nationkey AS family, feature FROM (SELECT n_nationkey, c_custkey, unnest(['L:' || n_name, 'S:' || c_mktsegment, 'H:' || c_acctbal::BIGINT % 2]) AS feature FROM nation JOIN customer ON c_nationkey = n_nationkey) JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS all_of FROM customer GROUP BY 1) USING (n_nationkey) GROUP BY n_nationkey, feature, all_of HAVING count(*) < all_of")
def g22_broken_claims(t: Tables) -> DataFrame:
    """Nations whose customers do not all have what some of them have, told by the invariant of fingerprints."""
    own = F.array(F.concat(F.lit("L:"), "n_name"), F.concat(F.lit("S:"), "c_mktsegment"), F.concat(F.lit("H:"), (F.round("c_acctbal").cast("long") % 2).cast("string")))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("family"), F.col("c_custkey").alias("node"), F.explode(own).alias("feature"))
    claims = rows.groupBy("family").agg(F.collect_set("feature").alias("fingerprint"))
    return P.broken_fingerprints(rows.select("family", "node").distinct(), claims, rows)


def _bridged(t: Tables) -> DataFrame:
    """(node, package, components) of customers: twelve names that thirty neighbours by key have, and six of a third of them."""
    spelt = lambda c: F.regexp_replace(F.translate(c.cast("string"), "0123456789", "bcdfghklmn"), "(.)", "$1a")
    g, s = spelt(F.floor(F.col("c_custkey") / 30)), spelt(F.col("c_custkey") % 3)
    shared = [F.concat(F.lit("org.group"), g, F.lit(f".bridge.Bridge{x}"), g) for x in "ABCDEFGHIJKL"]
    own = [F.concat(F.lit("org.part"), g, s, F.lit(f".own.Own{x}"), g, s) for x in "ABCDEF"]
    return t.customer.select(F.col("c_custkey").alias("node"), F.lit("com.shop").alias("package"), F.concat_ws(" ", *shared, *own).alias("components"))


@query("SELECT min(c_custkey) OVER (PARTITION BY c_custkey // 30) AS weak, min(c_custkey) OVER (PARTITION BY c_custkey // 30, c_custkey % 3) AS family, c_custkey AS node FROM customer")
def g14_divided_customers(t: Tables) -> DataFrame:
    """Groups of customers that bridging names hold together, divided without these."""
    apps = _bridged(t)
    n = apps.count()
    members = checkpointed(P.bounded(P.second_features(apps), n))
    core = checkpointed(P.core_links(*P.second_class_links(members, n)))
    groups = checkpointed(P.strict_groups(core, members).select("family", "node"))
    return P.divided_again(groups, members, n)


def _built(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Libraries (node, package, uri) and classes (node, class) of customers.

    Thirty neighbours by key share ten libraries, but every third thirty has common packages alone and shares ten classes.
    """
    k, g = F.col("c_custkey"), F.floor(F.col("c_custkey") / 30)
    path = lambda x, c: F.concat(F.lit(f"package:{x}"), c.cast("string"), F.lit("/"))
    libraries = [F.concat(path("shop", g), F.lit(f"{x}.dart")) for x in range(10)] + [F.concat(path("own", k), F.lit("0.dart"))]
    common = [F.lit(f"package:{p}/a{x}.dart") for p in ("dio", "http", "maps_web") for x in range(4)] + [F.lit("dart:core"), F.lit("file:///h/.pub-cache/x.dart")]
    uris = F.when(g % 3 == 0, F.array(*common)).otherwise(F.array(*libraries, *common))
    names = F.array(*(F.concat(F.lit(f"Order{x}G"), g.cast("string"), F.lit("<T>" if x in "BDFHJ" else "")) for x in "ABCDEFGHIJ"), F.lit("MyApp"), F.lit("_Private"), F.lit("Ab1"), F.concat(F.lit("Only"), k.cast("string")))
    return t.customer.select(k.alias("node"), F.concat(F.lit("own"), k.cast("string")).alias("package"), F.explode(uris).alias("uri")), t.customer.select(k.alias("node"), F.explode(names).alias("class"))


@query("SELECT min(c_custkey) OVER (PARTITION BY c_custkey // 30) AS family, c_custkey AS node, CASE WHEN c_custkey // 30 % 3 = 0 THEN 'classes' ELSE 'libraries' END AS stage FROM customer QUALIFY count(*) OVER (PARTITION BY c_custkey // 30) > 1")
def g21_library_families(t: Tables) -> DataFrame:
    """Families of customers by libraries, then by classes."""
    return B.library_families(*_built(t))[0]
