import json
from pyspark.sql import functions as F

from quarrion.operators import intervals as I
from quarrion.sources import readers, sinks
from quarrion.streaming import jobs

#: Seconds after which a stream that has not ended fails its test.
LIMIT = 120


def run(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(LIMIT), f"{name} does not end"
    finally:
        q.stop()
    return spark.table(name)


def folder(df, tmp_path):
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return path


def test_stream_forms_agree_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = folder(events, tmp_path)
    stream = jobs.files(spark, path, events.schema)
    bounds = I.step_bounds(events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("step"), F.col("ts").alias("start")), "user_id", "start", [F.col("start"), F.col("step")])
    got = run(spark, jobs.assign_steps(stream, bounds, "user_id", "ts").select("event_id", "step"), "steps", tmp_path)
    want = I.assign_by_range(events, bounds.drop("until"), "user_id", "ts", "start", "step").select("event_id", "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = run(spark, jobs.without_bursts(stream, ["user_id", "event_type"], "ts", 86400.0).select("event_id"), "bursts", tmp_path)
    batch = I.without_bursts(events, ["user_id", "event_type"], "ts", 86400.0, ["event_id"]).select("event_id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, batch.collect()))
    first = run(spark, jobs.first_of_each(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "firsts", tmp_path)
    assert first.count() == events.select("user_id", "event_type").distinct().count()
    hours = run(spark, jobs.counts(stream, "ts", ["event_type"], "1 day", "1 hour"), "windows", tmp_path, "complete")
    assert hours.agg(F.sum("n")).first()[0] == events.count()


def test_bursts_over_several_batches(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 0.0), (2, "a", 0.05), (3, "a", 0.14), (4, "b", 0.2), (5, "a", 0.3), (6, "a", 90.0), (7, "b", 90.05), (8, "a", 90.06)]
    path = str(tmp_path / "in")
    for lo in range(0, len(rows), 2):
        part = [(i, k, day + dt.timedelta(seconds=s)) for i, k, s in rows[lo : lo + 2]]
        spark.createDataFrame(part, "id int, k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.files(spark, path, "id int, k string, ts timestamp", 1)
    got = run(spark, jobs.without_bursts(stream, ["k"], "ts", 0.1, "10 seconds"), "burst_batches", tmp_path)
    assert sorted(r.id for r in got.collect()) == [1, 4, 5, 6, 7]


def test_requests_meet_their_responses(spark, sf_dir, tmp_path):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("at"))
    stream = jobs.files(spark, folder(talk, tmp_path), talk.schema)
    got = {(r.conv_id, r.request): r.response for r in run(spark, jobs.request_pairs(stream, "conv_id", "turn", "role", "user", "assistant", "at"), "pairs", tmp_path).collect()}
    want = I.request_pairs(talk, "conv_id", "turn", "role", "user", "assistant", []).collect()
    assert got == {(r.conv_id, r.request_turn): r.response_turn for r in want if (r.conv_id, r.request_turn) in got}
    assert {(r.conv_id, r.request_turn) for r in want if r.complete} <= set(got)


def test_requests_over_several_batches(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "q", 0), (2, 1, "q", 0), (1, 2, "a", 5), (1, 3, "x", 6), (1, 4, "q", 9), (1, 5, "q", 10), (3, 1, "a", 5000), (3, 2, "q", 5001), (3, 3, "a", 9000), (3, 4, "a", 9001)]
    path = str(tmp_path / "in")
    for lo in range(0, len(rows), 2):
        part = [(c, t, k, day + dt.timedelta(seconds=s)) for c, t, k, s in rows[lo : lo + 2]]
        spark.createDataFrame(part, "c long, t long, k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.files(spark, path, "c long, t long, k string, ts timestamp", 1)
    got = run(spark, jobs.request_pairs(stream, "c", "t", "k", "q", "a", "ts", "1 second", 4000), "pair_batches", tmp_path)
    assert sorted((r.c, r.request, r.response, r.complete) for r in got.collect()) == [(1, 1, 2, True), (1, 4, None, False), (1, 5, None, False), (2, 1, None, False), (3, 2, 3, True)]


def test_micro_batches_have_one_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    stream = jobs.files(spark, folder(df, tmp_path), df.schema)
    seen = []
    assert jobs.into_table(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "check")).awaitTermination(LIMIT)
    assert seen == [(0, 2)]


def test_packets(spark, tmp_path):
    def line(**v):
        return "\t".join(str(v.get(f.replace(".", "_"), "")) for f in readers.PACKET_FIELDS)

    rows = [
        line(frame_number=1, frame_time_epoch="1.5", ip_src="10.0.0.1,9.9.9.9", ip_dst="8.8.8.8", tcp_srcport=1, tcp_dstport=443, frame_protocols="eth:ip:tcp:tls", tls_handshake_extensions_server_name="b.org"),
        line(frame_number=2, ipv6_src="::1", ipv6_dst="::2", udp_srcport=5, udp_dstport=53, frame_protocols="eth:ipv6:udp:dns", dns_a="1.2.3.4,5.6.7.8"),
        line(frame_number=3, frame_protocols="eth:arp"),
    ]
    (tmp_path / "p.tsv").write_text("\n".join(rows))
    got = [tuple(r) for r in readers.normal_packets(readers.packets(spark, str(tmp_path / "p.tsv"))).orderBy("frame").collect()]
    assert got == [(1, 1.5, "10.0.0.1", "8.8.8.8", 1, 443, "TLS", "b.org", None), (2, None, "::1", "::2", 5, 53, "DNS", None, "1.2.3.4")]


def test_other_formats(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.json"), "a int").collect()) == [1, 2]
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 3}]))
    assert sorted(r.a for r in readers.json_array(spark, str(tmp_path / "a.json"), "a int").collect()) == [1, 3]
    (tmp_path / "w.csv").write_text("Domain\nA.org\n a.org\n\n")
    assert [r.domain for r in readers.allow_list(spark, str(tmp_path / "w.csv")).collect()] == ["a.org"]
    src = tmp_path / "src" / "x"
    src.mkdir(parents=True)
    (src / "A.java").write_text("class A {}")
    (src / "B.java").write_text("x" * 2000)
    assert [r.text for r in readers.sources(spark, str(tmp_path / "src"), most=1000).collect()] == ["class A {}"]
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 1)], "value string, n int")
    sinks.tokens_gz(df, str(tmp_path / "gz"))
    assert [r.value for r in readers.tokens(spark, str(tmp_path / "gz")).collect()] == ["a", "b"]
    sinks.tsv(df, str(tmp_path / "tsv"))
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "tsv"), ["v", "n"]).orderBy("v").collect()] == [("a", "2"), ("b", "1")]
    sinks.report(df.withColumn("list", F.array("value")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).count() == 3


def test_replacing_and_merging(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "task int, v string"), path, "task")
    sinks.replace_partitions(spark.createDataFrame([(2, "c"), (2, "d")], "task int, v string"), path, "task")
    assert sorted((r.task, r.v) for r in readers.table(spark, path).collect()) == [(1, "a"), (2, "c"), (2, "d")]
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string"), spark.createDataFrame([(2, "n"), (3, "m")], "k int, v string")
    sinks.upsert(old, new, ["k"], str(tmp_path / "u"))
    assert sorted(tuple(r) for r in readers.table(spark, str(tmp_path / "u")).collect()) == [(1, "a", "x"), (2, "n", "y"), (3, "m", None)]
    sinks.backup(old, "copy_of_old", ["k", "v"])
    assert spark.table("copy_of_old").count() == 2


def test_changed_rows_are_counted(spark, tmp_path):
    from quarrion.operators.transitions import set_where

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, v string")
    assert sinks.written(set_where(df, F.col("v") == "b", {"v": "c"}), str(tmp_path / "w")) == 2
    assert sorted(tuple(r) for r in readers.table(spark, str(tmp_path / "w")).collect()) == [(1, "a"), (2, "c"), (3, "c")]


def test_traces_replace_those_of_their_tasks(spark, tmp_path):
    path = str(tmp_path / "traces")
    for rows in ([(1, "x"), (2, "y")], [(2, "z")]):
        sinks.replace_traces({"steps": spark.createDataFrame(rows, "task_id int, v string"), "packets": spark.createDataFrame(rows, "task_id int, v string")}, path)
    for name in ("steps", "packets"):
        assert sorted((r.task_id, r.v) for r in readers.table(spark, f"{path}/{name}").collect()) == [(1, "x"), (2, "z")]


def test_one_scan_for_two_collectors(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    scan = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i int, t string").mapInArrow(seen, "i int, t string")
    odd, longest = sinks.scan_once(scan, lambda d: d.where("i % 2 = 1"), lambda d: d.agg(F.max(F.length("t")).alias("n")))
    assert odd.count() == 10 and longest.first().n == 3 and reads.value == 20


def test_fingerprints_are_validated(spark, tmp_path):
    import pytest

    def read(entries):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(entries, indent=1))
        return readers.fingerprints(spark, str(path))

    good = {"product": "acme.sdk", "prefixes": ["com.acme"], "credentials": ["key=(?P<key>[0-9a-f]+)"]}
    assert [(f.product, f.prefixes) for f in read([good, {"product": "b", "recognised_by": "x+"}])] == [("acme.sdk", ("com.acme",)), ("b", ())]
    for bad in ([], {}, [good, good], [{"product": "Bad Name", "prefixes": ["a"]}], [{"product": "a"}], [{"product": "a", "prefixes": ["b"], "credentials": ["no(group)"]}], [{"product": "a", "recognised_by": "("}]):
        with pytest.raises(ValueError):
            read(bad)
