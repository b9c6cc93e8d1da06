"""Dashboards, top-N summaries, step intervals and state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions import text as X
from quarrion.operators import intervals as I
from quarrion.operators import relational as R
from quarrion.operators import transitions as M
from quarrion.plans.registry import Tables, query


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-07-01') AS recent, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-07-01') AS recent_done, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS online FROM orders")
def a01_scalar_counts(t: Tables) -> DataFrame:
    recent, done = F.col("o_orderdate") >= F.expr("timestamp'1998-07-01'"), F.col("o_orderstatus") == "F"
    counts = t.orders.agg(F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.count_if(done & recent).alias("recent_done"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("open"), F.count_if(done).alias("done"))
    online = t.supplier.agg(F.count_if(F.col("s_acctbal") > 0).alias("online"))
    return counts.join(F.broadcast(online), F.lit(True))  # one row each


@query("SELECT o_orderpriority, coalesce(round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 2), 0.0) AS rate FROM orders GROUP BY 1")
def a02_success_rate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(R.ratio_percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("rate"))


_DAILY = """SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = CAST(d AS DATE)) AS submitted, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F' AND CAST(l_shipdate AS DATE) = CAST(d AS DATE)) AS shipped
FROM range(DATE '1998-06-01', DATE '1998-09-01', INTERVAL 1 DAY) AS r(d)"""


@query(_DAILY)
def a03_daily_two_dates(t: Tables) -> DataFrame:
    return R.daily([(t.orders, "o_orderdate", "submitted", None), (t.lineitem, "l_shipdate", "shipped", F.col("l_linestatus") == "F")], "1998-06-01", "1998-08-31")


@query("SELECT CAST(d AS DATE) AS day, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = CAST(d AS DATE)) AS n FROM range(DATE '2023-12-25', DATE '2024-01-08', INTERVAL 1 DAY) AS r(d)")
def a04_zero_filled_days(t: Tables) -> DataFrame:
    return R.daily([(t.events, "ts", "n", F.col("event_type") == "purchase")], "2023-12-25", "2024-01-07")


@query("SELECT n_name, count(c_custkey) AS n, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY n DESC, best DESC, n_name")
def a05_group_count_and_max(t: Tables) -> DataFrame:
    c = t.customer.where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.count("*").alias("k"), F.max("c_acctbal").alias("b"))
    return t.nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("n"), F.col("b").alias("best")).orderBy(F.desc("n"), F.desc("best"), "n_name")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-06-08' GROUP BY 1")
def a06_windowed_group_count(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate >= timestamp'1998-06-01' and l_shipdate < timestamp'1998-06-08'").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def a07_functional_dependence(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "c_mktsegment", "n")


@query("SELECT count(*) FILTER (WHERE trim(text) <> '') AS text, count(*) FILTER (WHERE trim(lang) <> '') AS lang, count(*) FILTER (WHERE trim(source) <> '') AS source FROM documents")
def a08_non_empty_counts(t: Tables) -> DataFrame:
    return t.documents.agg(*(F.count_if(~X.is_blank(c)).alias(c) for c in ("text", "lang", "source")))


@query("SELECT count(*) AS total FROM orders WHERE o_orderpriority ILIKE '%low%'")
def a09_filtered_total(t: Tables) -> DataFrame:
    return t.orders.where(R.all_of(R.holds_text("low", "o_orderpriority"))).agg(F.count("*").alias("total"))


@query("SELECT count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS admins, count(*) FILTER (WHERE c_acctbal < 0) AS busy FROM customer")
def a10_conditional_counts(t: Tables) -> DataFrame:
    return t.customer.agg(F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("admins"), F.count_if(F.col("c_acctbal") < 0).alias("busy"))


@query("SELECT DISTINCT p_brand FROM part ORDER BY 1")
def a11_distinct_ordered(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct().orderBy("p_brand")


_TOP = """WITH c AS (SELECT CAST({0} AS VARCHAR) AS label, count(*) AS n FROM {1} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rk, sum(n) OVER () AS total FROM c)
SELECT CAST(least(rk, 11) AS INT) AS rank, CASE WHEN rk <= 10 THEN label ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n, round(sum(n) * 100.0 / max(total), 1) AS percent, greatest(round(sum(n) * 100.0 / max(total), 1), 3.0) AS bar FROM r GROUP BY 1, 2"""


@query(_TOP.format("user_id", "events"))
def a12_top_share(t: Tables) -> DataFrame:
    return R.top_share(t.events, "user_id")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def a13_step_rollup(t: Tables) -> DataFrame:
    bad = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))


@query("SELECT user_id, event_type, first_at, CAST(row_number() OVER (ORDER BY first_at, user_id, event_type) AS INT) AS seq FROM (SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY ALL)")
def a14_first_seen_targets(t: Tables) -> DataFrame:
    return R.first_seen(t.events, ["user_id", "event_type"], F.col("ts"))


@query("SELECT event_type, user_id, min(CASE WHEN event_id % 2 = 0 THEN 80 ELSE 443 END) AS port, min(event_id) AS first_at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL")
def a15_controller_targets(t: Tables) -> DataFrame:
    e = t.events.where("event_type in ('purchase', 'error')").withColumn("port", F.when(F.col("event_id") % 2 == 0, 80).otherwise(443))
    return e.groupBy("event_type", "user_id").agg(F.min("port").alias("port"), F.min("event_id").alias("first_at"))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS packets, count(*) AS n FROM (SELECT DISTINCT user_id, event_id, ts FROM events WHERE event_type = 'purchase') GROUP BY 1")
def a16_packet_lists(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'purchase'").dropDuplicates(["event_id"])
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("packets"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS credential FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{9,}') AS w FROM conversations)")
def a17_outer_explode(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0))).alias("credential"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) > 8) AS dangerous, len(list_filter(string_split(text, ' '), lambda x: length(x) <= 8)) AS normal FROM documents")
def a18_split_list(t: Tables) -> DataFrame:
    w = F.split("text", " ")
    return t.documents.select("doc_id", F.filter(w, lambda x: F.length(x) > 8).alias("dangerous"), F.size(F.filter(w, lambda x: F.length(x) <= 8)).cast("long").alias("normal"))


@query("SELECT lower(coalesce(nullif(regexp_extract(url, '/(en|de|fr|es)/', 1), ''), 'unknown')) AS abi, count(*) AS n, min(page_id) AS first_at FROM pages GROUP BY 1")
def a19_grouped_by_segment(t: Tables) -> DataFrame:
    abi = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", "/(en|de|fr|es)/", 1), F.lit("")), F.lit("unknown")))
    return t.pages.groupBy(abi.alias("abi")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_at"))


@query("SELECT md5(text) AS digest, min(doc_id) AS first_id, list(doc_id ORDER BY doc_id) AS ids, bool_or(lang = 'en') AS any_en FROM documents GROUP BY 1 HAVING count(*) > 1")
def a20_grouped_by_digest(t: Tables) -> DataFrame:
    g = t.documents.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.sort_array(F.collect_list("doc_id")).alias("ids"), F.bool_or(F.col("lang") == "en").alias("any_en"))
    return g.where("n > 1").drop("n")


@query("SELECT source, max(n_chars) AS most, arg_max(doc_id, n_chars * 1000000 - doc_id) AS best FROM documents GROUP BY 1")
def a26_best_of_signature(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.max("n_chars").alias("most"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type IN ('view', 'click')) >= greatest(1, floor(0.8 * count(*))) AS dropped FROM events GROUP BY 1")
def a27_share_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type").isin("view", "click")) >= F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.count("*")))).alias("dropped"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a28_status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT md5(text)) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT md5(text)) >= 5")
def a29_distinct_gate(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count_distinct(F.md5("text")).alias("n")).where("n >= 5")


@query("SELECT event_id, s AS scheme, event_id % s = 0 AS present FROM events, (VALUES (1), (2), (3)) v(s) WHERE event_type = 'signup'")
def a30_struct_flatten(t: Tables) -> DataFrame:
    flags = F.array(*(F.struct(F.lit(s).alias("scheme"), (F.col("event_id") % s == 0).alias("present")) for s in (1, 2, 3)))
    return t.events.where("event_type = 'signup'").select("event_id", F.inline(flags))


_ASOF = "SELECT e.event_id, e.user_id, e.event_type, e.ts, s.event_id AS step, s.ts AS step_start FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts"


def _steps(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("step_id"), F.col("ts").alias("start"))


def _assigned(t: Tables) -> DataFrame:
    return I.assign_steps(t.events.select("event_id", "user_id", "event_type", "ts"), _steps(t), "user_id", "ts", "start", "step_id")


@query(_ASOF)
def t01_step_intervals(t: Tables) -> DataFrame:
    return _assigned(t).select("event_id", "user_id", "event_type", "ts", "step", "step_start")


@query(_ASOF)
def j06_range_join(t: Tables) -> DataFrame:
    found = I.assign_by_range(t.events.select("event_id", "user_id", "event_type", "ts"), _steps(t), "user_id", "ts", "start", "step_id")
    return found.select("event_id", "user_id", "event_type", "ts", "step", "step_start")


@query("SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'signup'")
def w01_step_bounds(t: Tables) -> DataFrame:
    return I.step_bounds(t.events.where("event_type = 'signup'").select("user_id", "event_id", "ts"), "user_id", "ts", [F.col("ts"), F.col("event_id")])


_FIRSTS = f"SELECT user_id, step, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, step, event_type ORDER BY ts, event_id) AS n FROM ({_ASOF})) WHERE n = 1"


@query(_FIRSTS)
def t03_first_per_step(t: Tables) -> DataFrame:
    return I.first_of_each(_assigned(t), ["user_id", "step", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "step", "event_type", "event_id")


@query(_TOP.format("step", f"({_FIRSTS})"))
def flagship_step_summary(t: Tables) -> DataFrame:
    """Events to steps, first of each kind a step, then the steps with the most kinds."""
    firsts = I.first_of_each(_assigned(t), ["user_id", "step", "event_type"], [F.col("ts"), F.col("event_id")])
    return R.top_share(firsts, "step")


@query("SELECT event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 1 DAY")
def t04_burst_suppression(t: Tables) -> DataFrame:
    return I.without_bursts(t.events, ["user_id", "event_type"], "ts", 86400, ["event_id"]).select("event_id")


@query("""WITH m AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS tr FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CAST(tr AS BIGINT) AS transaction, min(turn) FILTER (WHERE role = 'user') AS request_turn, min(turn) FILTER (WHERE role = 'assistant') AS response_turn, count(*) FILTER (WHERE role = 'assistant') AS n_responses, count(*) FILTER (WHERE role = 'assistant') > 0 AS complete FROM m WHERE tr > 0 GROUP BY 1, 2""")
def t02_request_pairs(t: Tables) -> DataFrame:
    return I.request_pairs(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role", "user", "assistant", [])


@query("SELECT s_suppkey, coalesce(max(l_shipdate) >= TIMESTAMP '1998-11-01' - INTERVAL 30 DAY, false) AS fresh FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def t05_freshness(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("at"))
    s = t.supplier.join(last, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return s.select("s_suppkey", M.is_fresh("at", F.expr("timestamp'1998-11-01'"), 30 * 86400).alias("fresh"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1998-07-01' - INTERVAL 400 DAY")
def t06_expired(t: Tables) -> DataFrame:
    return M.expired(t.orders, "o_orderdate", F.expr("timestamp'1998-07-01'"), 400 * 86400, "o_orderstatus", ["O", "P"]).select("o_orderkey", "o_custkey")


@query("""WITH j AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'), w AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0) SELECT o_orderkey, s_suppkey, CAST(n AS INT) AS turn FROM j JOIN w USING (n)""")
def t07_allocation(t: Tables) -> DataFrame:
    jobs, workers = t.orders.where("o_orderstatus = 'O'"), t.supplier.where("s_acctbal > 0")
    return M.allocate(jobs, workers, [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], [F.col("s_acctbal"), F.col("s_suppkey")]).select("o_orderkey", "s_suppkey", "turn")


@query("SELECT conv_id, turn, role || ' ' || lead(role, 1) OVER w || ' ' || lead(role, 2) OVER w || ' ' || lead(role, 3) OVER w AS gram FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lead(role, 3) OVER w IS NOT NULL")
def w05_sliding_grams(t: Tables) -> DataFrame:
    return I.sliding(t.conversations, "conv_id", "turn", "role")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def m01_partial_update(t: Tables) -> DataFrame:
    patch = t.customer.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("x").alias("c_name"))
    return M.patched(t.customer, patch, "c_custkey", ["c_acctbal"]).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey < 500 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'P' AND o_custkey < 500 AS changed FROM orders")
def m02_compare_and_set(t: Tables) -> DataFrame:
    return M.set_where(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_custkey") < 500), {"o_orderstatus": "X"}).select("o_orderkey", "o_orderstatus", "changed")


@query("WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey) <= 25 AS hit FROM orders) SELECT o_orderkey, CASE WHEN hit AND o_orderkey % 2 = 0 THEN 'F' WHEN hit THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN hit AND o_orderkey % 2 = 1 THEN 't1' END AS token FROM r")
def m03_claim_with_token(t: Tables) -> DataFrame:
    taken = M.claimed(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), F.col("o_orderstatus") == "O", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], "t1", 25, "o_orderstatus", "R")
    good = taken.where("token = 't1' and o_orderkey % 2 = 0").select("o_orderkey", "token", F.lit("F").alias("outcome"))
    stale = taken.where("token = 't1' and o_orderkey % 2 = 1").select("o_orderkey", F.lit("t0").alias("token"), F.lit("F").alias("outcome"))
    return M.finished(taken, good.unionByName(stale), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "token")


@query("WITH x AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 9 = 0) SELECT 'job' AS kind, o_orderkey AS id, 'pending' AS state FROM x UNION ALL SELECT DISTINCT 'worker', o_custkey, 'quarantined' FROM x")
def m04_requeue_and_quarantine(t: Tables) -> DataFrame:
    hit = t.orders.where("o_orderstatus = 'P' and o_custkey % 9 = 0")
    jobs = hit.select(F.lit("job").alias("kind"), F.col("o_orderkey").alias("id"), F.lit("pending").alias("state"))
    return jobs.unionByName(hit.select(F.lit("worker").alias("kind"), F.col("o_custkey").alias("id"), F.lit("quarantined").alias("state")).distinct())


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c_acctbal < 0 THEN 'failed' ELSE o_orderstatus END AS o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey")
def m05_guarded_fail(t: Tables) -> DataFrame:
    owned = t.orders.join(t.customer.select("c_custkey", "c_acctbal"), F.col("c_custkey") == F.col("o_custkey"))
    return M.set_where(owned, (F.col("o_orderstatus") == "O") & (F.col("c_acctbal") < 0), {"o_orderstatus": "failed"}).select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'approved' WHEN c_custkey % 3 = 0 THEN 'pending' ELSE CASE c_custkey % 4 WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' ELSE 'rejected' END END AS status,
CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer""")
def m06_reviewed_upsert(t: Tables) -> DataFrame:
    m = F.col("c_custkey") % 4
    old = t.customer.select(F.col("c_custkey").alias("k"), F.when(m == 0, "approved").when(m == 2, "failed").otherwise("rejected").alias("status"), F.lit("old").alias("v"))
    new = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return M.reviewed_upsert(old, new, "k", "status", ["approved", "pending"], "pending")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) >= 5 AND bool_and(o_orderstatus <> 'P') AS approved FROM orders GROUP BY 1")
def m07_approval_checks(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(((F.count_distinct("o_orderpriority") >= 5) & F.bool_and(F.col("o_orderstatus") != "P")).alias("approved"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'rejected' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def m08_reject_open(t: Tables) -> DataFrame:
    return M.set_where(t.orders, F.col("o_orderstatus").isin("P", "O"), {"o_orderstatus": "rejected"}).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, NULL::BIGINT AS kept_supp FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT l_orderkey, CASE WHEN s_acctbal > 0 THEN l_suppkey END FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1")
def m09_cascade_and_null(t: Tables) -> DataFrame:
    orders = M.cascaded(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", F.lit(None).cast("long").alias("kept_supp"))
    lines = M.nulled(t.lineitem.where("l_linenumber = 1"), t.supplier.where("s_acctbal > 0"), "l_suppkey", "s_suppkey")
    return orders.unionByName(lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("kept_supp")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'busy' WHEN s_suppkey % 7 = 0 THEN 'offline' WHEN s_acctbal < 0 THEN 'quarantined' ELSE 'online' END AS status FROM supplier")
def m10_health(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 10 == 0, "busy").otherwise("online").alias("status"))
    probe = t.supplier.where("s_suppkey % 7 <> 0").select("s_suppkey", F.lit(True).alias("reachable"), (F.col("s_acctbal") >= 0).alias("healthy"))
    return M.health(rows, probe, "s_suppkey").select("s_suppkey", "status")


def _messages(t: Tables) -> DataFrame:
    """Turns as frames of a capture: users ask, assistants answer the turn before, and every third answer is data of the first turn's stream."""
    frame = F.col("conv_id") * 1000 + F.col("turn")
    kind = F.when(F.col("role") == "user", "request").when(F.col("turn") % 3 == 2, "data").otherwise("response")
    return t.conversations.select(kind.alias("kind"), frame.alias("frame"), (frame - 1).alias("request_frame"), F.col("conv_id").alias("stream"), F.floor(F.col("turn") / 4).alias("stream_id"), F.octet_length("text").cast("long").alias("size"))


_MESSAGES = "m AS (SELECT CASE WHEN role = 'user' THEN 'request' WHEN turn % 3 = 2 THEN 'data' ELSE 'response' END AS kind, conv_id * 1000 + turn AS frame, conv_id AS stream, turn // 4 AS stream_id, strlen(text) AS size FROM conversations)"


@query(f"WITH {_MESSAGES} SELECT q.frame AS request, min(r.frame) AS response, q.stream FROM m q LEFT JOIN m r ON r.kind = 'response' AND r.frame - 1 = q.frame WHERE q.kind = 'request' GROUP BY q.frame, q.stream")
def j12_answers_by_frame(t: Tables) -> DataFrame:
    return I.answers_by_frame(_messages(t), ["stream"])


@query(f"WITH {_MESSAGES}, q AS (SELECT stream, stream_id, min(frame) AS request FROM m WHERE kind = 'request' GROUP BY 1, 2) SELECT request, count(d.frame) AS n_data, coalesce(sum(d.size), 0) AS n_bytes FROM q LEFT JOIN m d ON d.kind = 'data' AND d.stream = q.stream AND d.stream_id = q.stream_id GROUP BY request")
def j12_data_by_stream(t: Tables) -> DataFrame:
    return I.data_by_stream(_messages(t))
