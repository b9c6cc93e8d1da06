"""Filters, lookups, pages, set operations and sinks on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions import text as X
from quarrion.operators import relational as R
from quarrion.operators.similarity import mode_share, without_contained
from quarrion.plans.registry import Tables, query

def _recent() -> list:
    return [F.desc("o_orderdate"), F.desc("o_orderkey")]


@query("SELECT * FROM orders WHERE o_orderpriority ILIKE '%high%' AND o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND o_custkey = o_custkey")
def p01_conjunctive_filter(t: Tables) -> DataFrame:
    return t.orders.where(R.all_of(R.holds_text("high", "o_orderpriority"), R.equals("F", "o_orderstatus"), R.within("o_orderdate", F.expr("timestamp'1996-01-01'"), F.expr("timestamp'1998-12-31'")), R.equals(None, "o_custkey"), F.col("o_custkey").isNotNull()))


@query("SELECT p.p_partkey, p.p_name, l.l_returnflag FROM part p LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) l ON l_partkey = p_partkey WHERE p_brand ILIKE 'brand#1%' AND trim(p_name) <> '' AND (l_returnflag IS NULL OR l_returnflag IN ('A', 'N'))")
def p02_prefix_and_nullable_parent(t: Tables) -> DataFrame:
    last = t.lineitem.where("l_quantity >= 49").groupBy("l_partkey").agg(F.max("l_returnflag").alias("l_returnflag"))
    met = t.part.join(last, F.col("p_partkey") == F.col("l_partkey"), "left")
    return met.where(F.col("p_brand").ilike("brand#1%") & ~X.is_blank("p_name") & R.any_of(F.col("l_returnflag").isNull(), R.one_of("l_returnflag", ["N", "A", "N "]))).select("p_partkey", "p_name", "l_returnflag")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 7, 42, 99)")
def p03_id_list(t: Tables) -> DataFrame:
    return t.customer.where(R.one_of("c_custkey", [42, 7, 3, 3, 99])).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (1, 5, 9) OR (l_orderkey % 7 = 0 AND l_linenumber IN (2, 3))")
def p04_id_or_position(t: Tables) -> DataFrame:
    return t.lineitem.where(R.any_of(R.one_of("l_orderkey", [1, 5, 9]), (F.col("l_orderkey") % 7 == 0) & R.one_of("l_linenumber", [2, 3]))).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, count(*) AS n FROM events WHERE nullif(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, '') IS NULL OR nullif(trim(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE props END), '') IS NULL GROUP BY 1")
def p05_any_column_missing(t: Tables) -> DataFrame:
    gaps = t.events.select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("props")).alias("props"))
    return gaps.where(R.missing_any("kind", "props")).groupBy("user_id").agg(F.count("*").alias("n"))


@query('SELECT o_orderkey AS "orderKey", o_custkey AS "custKey", o_orderdate AS "createdAt" FROM orders')
def p06_camel_projection(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("orderKey"), F.col("o_custkey").alias("custKey"), F.col("o_orderdate").alias("createdAt"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, 'group ' || left(md5(text), 8)) AS label FROM documents")
def p07_default_label(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.default_label(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.md5("text"), "group ").alias("label"))


@query("SELECT page_id, html IS NOT NULL AND html <> '' AS has_html, url LIKE 'https://%' AS has_https FROM pages")
def p08_availability_flags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", (F.col("html").isNotNull() & (F.col("html") != "")).alias("has_html"), F.startswith("url", F.lit("https://")).alias("has_https"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND regexp_matches('step_' || (event_id % 10), '^step_[0-9]+$') AND props <> '' THEN props ELSE 'step_' || (event_id % 10) END AS action FROM events")
def p09_placeholder_action(t: Tables) -> DataFrame:
    step = F.concat(F.lit("step_"), (F.col("event_id") % 10).cast("string"))
    return t.events.select("event_id", F.when((F.col("event_type") == "error") & step.rlike("^step_[0-9]+$") & (F.col("props") != ""), F.col("props")).otherwise(step).alias("action"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM (SELECT o_orderpriority, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'fatal' WHEN lower(o_orderpriority) LIKE '%high%' OR lower(o_orderpriority) LIKE '%medium%' THEN 'retry' ELSE 'none' END = 'none' AS ok FROM orders) GROUP BY 1""")
def p14_signature_classes(t: Tables) -> DataFrame:
    low = F.lower("o_orderpriority")
    kind = F.when(F.contains(low, F.lit("urgent")), "fatal").when(R.any_of(*(F.contains(low, F.lit(x)) for x in ("high", "medium"))), "retry").otherwise("none")
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(kind == "none").alias("n_ok"))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 1 AND 40 AND regexp_matches(md5(CAST(l_orderkey AS VARCHAR)), '^[0-9a-f]{32}$') AND TRY_CAST(l_returnflag AS INT) IS NULL AS valid FROM lineitem")
def p16_validation(t: Tables) -> DataFrame:
    digest = X.normal_md5(F.concat(F.lit(" "), F.upper(F.md5(F.col("l_orderkey").cast("string")))))
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").between(1, 40) & digest.isNotNull() & F.col("l_returnflag").try_cast("int").isNull()).alias("valid"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 13")
def p17_owner_scope(t: Tables) -> DataFrame:
    return t.orders.where(R.all_of(R.equals(13, "o_custkey"))).select("o_orderkey", "o_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type IN ('click', 'view') AS flag FROM events")
def p18_json_decode(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.col("event_type").isin("click", "view").alias("flag"))


@query("SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = (SELECT min(l_returnflag) FROM lineitem)")
def p19_distinct_then_equality(t: Tables) -> DataFrame:
    first = t.lineitem.agg(F.min("l_returnflag").alias("flag"))
    return t.lineitem.join(F.broadcast(first), F.col("l_returnflag") == F.col("flag")).select("l_orderkey", "l_partkey", "l_shipdate")  # first is one row


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j01_left_lookup(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def j02_join_for_a_filter(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate, c_name, n_name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC")
def j03_deferred_page_join(t: Tables) -> DataFrame:
    lookups = [(t.customer, F.col("o_custkey") == F.col("c_custkey")), (t.nation, F.col("c_nationkey") == F.col("n_nationkey"))]
    return R.page_with(t.orders, "o_orderkey", _recent(), lookups, number=2, size=50).select("o_orderkey", "o_orderdate", "c_name", "n_name")


@query("SELECT n_name, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def j04_owner_scoped_left_join(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("k"), F.max("o_orderdate").alias("at"))
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(done, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.max("at").alias("latest"))


@query("WITH s AS (SELECT event_id AS step_id, user_id AS pos FROM events WHERE event_type = 'signup'), p AS (SELECT pos, min(step_id) AS by_pos FROM s GROUP BY 1) SELECT e.event_id, coalesce(s.step_id, p.by_pos) AS matched_id FROM events e LEFT JOIN s ON s.step_id = e.event_id LEFT JOIN p ON p.pos = e.user_id")
def j05_step_by_id_else_position(t: Tables) -> DataFrame:
    steps = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("step_id"), F.col("user_id").alias("pos"))
    return R.by_id_or_position(t.events, steps, "event_id", "user_id", "step_id", "pos").select("event_id", "matched_id")


@query("SELECT o_orderkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IS NULL OR n_regionkey IN (1, 2)")
def j07_inner_and_nullable_parent(t: Tables) -> DataFrame:
    met = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.where(R.any_of(F.col("n_regionkey").isNull(), R.one_of("n_regionkey", [1, 2]))).select("o_orderkey", "c_name")


@query("SELECT s_suppkey, s_name, n_name, coalesce(n, 0) AS shipped FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1) ON l_suppkey = s_suppkey")
def j08_left_to_grouped_count(t: Tables) -> DataFrame:
    recent = t.lineitem.where("l_shipdate >= timestamp'1998-06-01'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(recent, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", "n_name", F.coalesce("n", F.lit(0)).alias("shipped"))


@query("SELECT l_orderkey, l_linenumber, CAST(p_partkey IS NOT NULL AS INT) AS selected FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 5) ON p_partkey = l_partkey")
def j11_membership_flag(t: Tables) -> DataFrame:
    chosen = t.part.where("p_size <= 5").select("p_partkey")
    return t.lineitem.join(chosen, F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", F.col("p_partkey").isNotNull().cast("int").alias("selected"))


@query("SELECT event_id, coalesce(CASE WHEN e.event_id % 2 = 0 THEN CAST(e.user_id AS BIGINT) END, c_custkey) AS owner FROM events e LEFT JOIN customer ON c_custkey = e.user_id")
def j18_update_join(t: Tables) -> DataFrame:
    e = t.events.withColumn("owner", F.when(F.col("event_id") % 2 == 0, F.col("user_id")))
    return e.join(t.customer.select("c_custkey"), F.col("c_custkey") == F.col("user_id"), "left").select("event_id", F.coalesce("owner", "c_custkey").alias("owner"))


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 7 AND o_orderstatus = 'O' THEN 'seen' ELSE o_orderpriority END AS mark, c_nationkey = 7 AND o_orderstatus = 'O' AS changed FROM orders JOIN customer ON c_custkey = o_custkey")
def j19_owned_update(t: Tables) -> DataFrame:
    """Open orders are marked only where their customer belongs to the acting nation."""
    from quarrion.operators.transitions import set_where

    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("mark", F.col("o_orderpriority"))
    return set_where(rows, (F.col("c_nationkey") == 7) & (F.col("o_orderstatus") == "O"), {"mark": "seen"}).select("o_orderkey", "mark", "changed")


@query("SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")
def j20_scalar_subquery(t: Tables) -> DataFrame:
    latest = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    return t.customer.join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "latest")


@query("""WITH k AS (SELECT p_brand, p_size, p_partkey FROM part WHERE p_partkey % 4 = 0), m AS (SELECT p.p_partkey, k.p_size AS kp, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(p.p_size - k.p_size), k.p_size DESC) AS n FROM part p JOIN k USING (p_brand)) SELECT p_partkey, kp AS nearest FROM m WHERE n = 1""")
def j22_nearest_version(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_brand", F.array(F.col("p_size")).alias("v"))
    known = t.part.where("p_partkey % 4 = 0").select("p_brand", F.array(F.col("p_size")).alias("v")).distinct()
    return R.nearest_version(parts, known, ["p_brand"], "v").select("p_partkey", F.col("found_version")[0].alias("nearest"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def o01_page(t: Tables) -> DataFrame:
    return R.page(t.orders, _recent(), number=3, size=20).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def o02_latest_of_one(t: Tables) -> DataFrame:
    return R.page(t.orders.where("o_custkey = 7"), _recent(), size=1).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END, 1000000), o_orderdate, o_orderkey LIMIT 1")
def o03_next_by_priority(t: Tables) -> DataFrame:
    priority = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), F.lit(1000000))
    return R.page(t.orders.where("o_orderstatus = 'O'"), [priority, F.col("o_orderdate"), F.col("o_orderkey")], size=1).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def o04_clamped_page(t: Tables) -> DataFrame:
    return R.page(t.orders, _recent(), number=-3, size=5000).select("o_orderkey")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10000")
def o05_capped_listing(t: Tables) -> DataFrame:
    return R.page(t.events, [F.col("ts"), F.col("event_id")], size=10_000, largest=10_000).select("event_id", "ts")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def o06_optional_total(t: Tables) -> DataFrame:
    return t.orders.where(R.all_of(R.equals("F", "o_orderstatus"))).agg(F.count("*").alias("total"))


@query("SELECT user_id, ts, 'buy' AS branch FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, ts, 'err' FROM events WHERE event_type = 'error'")
def u01_union_of_logs(t: Tables) -> DataFrame:
    branch = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id", "ts", F.lit(name).alias("branch"))
    return branch("purchase", "buy").unionByName(branch("error", "err"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') AND value > 10 GROUP BY ALL")
def u02_union_then_count(t: Tables) -> DataFrame:
    branch = lambda kind: t.events.where((F.col("event_type") == kind) & (F.col("value") > 10)).select("user_id", "event_type")
    return branch("purchase").unionByName(branch("error")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS first_at FROM pages GROUP BY 1")
def u03_first_seen_urls(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.regexp_replace("url", "[?#].*$", "").alias("url")).agg(F.min("page_id").alias("first_at"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u06_set_difference(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS accepted FROM documents")
def u07_batch_rejects(t: Tables) -> DataFrame:
    return R.split_repeated(t.documents.select("doc_id", F.md5("text").alias("digest")), ["digest"], [F.col("doc_id")]).select("doc_id", "accepted")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END, 'none') AS v FROM orders")
def u08_first_non_empty(t: Tables) -> DataFrame:
    key = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", F.coalesce(X.blank_to_null(F.when(key == 0, F.col("o_orderpriority")).otherwise(" ")), X.blank_to_null(F.when(key == 1, F.col("o_orderstatus"))), F.lit("none")).alias("v"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w02_newest_of_each(t: Tables) -> DataFrame:
    return R.newest(t.orders, ["o_custkey"], _recent()).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey FROM orders")
def w03_numbering(t: Tables) -> DataFrame:
    return R.numbered(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")], by=["o_custkey"]).select(F.col("seq").cast("long").alias("seq"), "o_orderkey")


@query("SELECT l_suppkey, list(l_orderkey ORDER BY l_orderkey) AS l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE n <= 5 GROUP BY 1")
def w04_capped_collection(t: Tables) -> DataFrame:
    return R.capped_list(t.lineitem.select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey", [F.col("l_orderkey")], 5)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0")
def s20_replace_by_key(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_totalprice")
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return R.replaced_by_key(old, new, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_name FROM customer UNION ALL SELECT -c_custkey, c_acctbal * 2, NULL FROM customer WHERE c_custkey % 50 = 0 AND c_custkey > 0")
def s21_upsert(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"))
    more = t.customer.where("c_custkey % 50 = 0 and c_custkey > 0").select((-F.col("c_custkey")).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return R.merged(t.customer.select("c_custkey", "c_acctbal", "c_name"), new.unionByName(more), ["c_custkey"])


@query("SELECT l_suppkey, l_returnflag, n, share FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def a25_mode_share(t: Tables) -> DataFrame:
    return mode_share(t.lineitem, ["l_suppkey"], "l_returnflag")


@query("WITH h AS (SELECT DISTINCT 'all' AS k, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS v FROM pages) SELECT k, v FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.v LIKE '%.' || h.v)")
def g12_contained_suffixes(t: Tables) -> DataFrame:
    hosts = t.pages.select(F.lit("all").alias("k"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("v"))
    return without_contained(hosts, "k", "v")
