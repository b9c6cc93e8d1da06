import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from quarrion.llm import queries, sharding


def h64(*values, seed=42):
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot, grown) of rows (doc_id, text), by the definition."""
    placed = []
    for (doc, text), n in Counter(rows).items():
        raw = (text or "").encode()
        scores = [h64(doc, s) >> 11 for s in range(shards + 1)]
        best = max(range(shards), key=lambda s: (scores[s], -s))
        grown = shards if scores[shards] > scores[best] else best
        placed += [(doc, len(raw) + 16, zlib.crc32(raw), best, grown)] * n
    lots = Counter()
    keyed = defaultdict(list)
    for doc, size, crc, best, grown in placed:
        lot = lots[doc, size, crc] // sharding.COPIES
        lots[doc, size, crc] += 1
        place = h64(doc, size, crc, lot)
        keyed[best].append(((place ^ (1 << 63)), -1 if doc is None else doc, size, crc, lot, doc, grown))
    return sorted((doc is not None, doc or 0, size, crc, shard, slot, grown) for shard, found in keyed.items() for slot, (_, _, size, crc, _, doc, grown) in enumerate(sorted(found, key=lambda x: x[:5])))


def shown(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in df.collect())


def corpus():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aé漢 \n") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(-5, "minus"), (1 << 62, "big"), (400, None), (401, ""), (402, "x" * 300_000), (None, "no id"), (None, None)]
    return rows + [(7, "one text")] * 30 + [(i, "copied") for i in range(500, 560)] + [rows[3]] * 2


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    for copies in (1000, 4):
        monkeypatch.setattr(sharding, "COPIES", copies)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "_n": F.lit(1), "size": F.lit(None).cast("int")}).repartition(6)
        out = sharding.document_shards(df)
        assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert shown(out) == brute(rows, sharding.SHARDS)
        assert {r.law for r in out.select("law").distinct().collect()} == {"key"}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    before = sharding.placed(ids, F.col("doc_id"), [1.0] * 40)
    after = sharding.placed(ids, F.col("doc_id"), [1.0] * 41).select("doc_id", F.col("shard").alias("now"))
    rows = before.join(after, "doc_id").collect()
    assert all(r.now == r.grown_shard and r.now in (r.shard, 40) for r in rows)
    moved = sum(r.now == 40 for r in rows)
    assert abs(moved - 30_000 / 41) < 5 * (30_000 / 41) ** 0.5
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 40 and max(abs(n - 750) for n in sizes.values()) < 5 * 750**0.5


def test_weights_and_a_shard_that_goes(spark):
    ids = spark.range(40_000).select(F.concat(F.lit("doc-"), "id").alias("name"))
    rows = sharding.placed(ids, F.col("name"), [1.0, 2.0, 5.0, 2.0]).select("name", F.col("shard").alias("was")).join(sharding.placed(ids, F.col("name"), [1.0, 2.0, 0.0, 2.0]), "name").collect()
    share = Counter(r.was for r in rows)
    assert all(abs(share[s] / 40_000 - w / 10) < 0.01 for s, w in enumerate((1, 2, 5, 2)))
    assert all(r.shard == r.was for r in rows if r.was != 2) and all(r.shard != 2 for r in rows)
    left = Counter(r.shard for r in rows)
    assert all(abs(left[s] / 40_000 - w / 5) < 0.01 for s, w in ((0, 1), (1, 2), (3, 2)))


def test_written_shards_hold_every_record_once(spark, tmp_path):
    rows = [(i, "t" * (i % 50)) for i in range(500)] + [(9, "t")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks of a few rows stay apart
    try:
        sharding.written(df, str(tmp_path / "out"), F.col("doc_id"), [1.0] * 5, size=F.length("text"), file_bytes=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    want = {r.doc_id: r.shard for r in sharding.placed(df, F.col("doc_id"), [1.0] * 5).collect()}
    assert all(r.shard == want[r.doc_id] for r in back.collect())
    assert len(list((tmp_path / "out" / "shard=0").glob("*.parquet"))) > 1


def test_empty_table_and_no_python_in_the_plan(spark):
    empty = sharding.document_shards(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
    plan = empty._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(queries.ORACLES["op11_rendezvous_shards"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).items()) for r in cur.fetchall())
    got = queries.op11_rendezvous_shards(spark, sf_dir)
    assert sorted(tuple((n, r[n]) for n in names) for r in got.collect()) == want
