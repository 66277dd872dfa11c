"""The delta fold as a stream gives what the batch gives."""

import json
import random

from pyspark.sql import functions as F

from tessera.streaming import cdc


def deltas(spark):
    rows = [("a", "node", "INSERT", '{"l": 1}', 1), ("a", "node", "UPDATE", '{"c": 2}', 2), ("b", "node", "INSERT", "{}", 1), ("b", "node", "DELETE", None, 3), ("c", "node", "UPDATE", '{"x": 1}', 1)]
    return spark.createDataFrame(rows, "id string, type string, operation string, payload string, seq long").withColumn("ts", F.timestamp_seconds("seq")).select("id", "type", "operation", "payload", "ts", "seq")


def test_batch(spark):
    got = {r["id"]: (r["operation"], r["payload"]) for r in cdc.coalesce(deltas(spark)).collect()}
    assert got == {"a": ("INSERT", '{"c": 2, "l": 1}'), "c": ("UPDATE", '{"x": 1}')}


def test_stream_state(spark, tmp_path):
    source = str(tmp_path / "in")
    deltas(spark).where("seq = 1").write.parquet(source)
    stream = cdc.coalesce_stream(spark.readStream.schema(deltas(spark).schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    deltas(spark).where("seq > 1").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    last = spark.table("folded").groupBy("id").agg(F.max_by("operation", "version").alias("op"), F.max("version").alias("v"))
    assert {r["id"]: (r["op"], r["v"]) for r in last.collect()} == {"a": ("INSERT", 2), "b": ("NONE", 2), "c": ("UPDATE", 1)}


def test_foreach_batch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    deltas(spark).write.parquet(source)
    q = cdc.apply_stream(spark.readStream.schema(deltas(spark).schema).parquet(source), lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a", "c"]


def test_slices_fold_as_one(spark):
    rnd = random.Random(5)
    rows = []
    for key in range(60):
        for n in range(rnd.randint(1, 12)):
            operation = rnd.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
            payload = None if operation == "DELETE" else json.dumps({rnd.choice("xyz"): rnd.randint(0, 9)})
            rows.append((str(key), "node", operation, payload, n, rnd.choice([None, *range(0, 6 * 3600, 1200)])))
    table = spark.createDataFrame(rows, "id string, type string, operation string, payload string, seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for wins in (False, True):
        want = {}
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[5] is not None, r[5] or 0, r[4]))
            state = cdc._fold_rows([(r[2], r[3]) for r in own], None, wins)
            if state[0] is not None:
                want[key] = (state[0], json.loads(json.dumps(state[1])), len(own))
        for seconds in (60, 3600, 1 << 40):
            got = cdc.coalesce(table.select("id", "type", "operation", "payload", "ts", "seq"), wins, seconds).collect()
            assert {r["id"]: (r["operation"], json.loads(r["payload"]), r["version"]) for r in got} == want


def test_queue_of_jobs(spark):
    rows = [("a", "low", 1), ("b", "normal", 2), ("c", "high", 3), ("a", "high", 4), ("d", "normal", 5), ("e", "odd", 6), ("f", "high", 7)]
    jobs = spark.createDataFrame(rows, "node_id string, priority string, seq long")
    busy = spark.createDataFrame([("f",)], "node_id string")
    got = sorted((r["place"], r["node_id"]) for r in cdc.job_queue(jobs, busy, order=("seq",)).collect())
    assert got == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]
