import random

from pyspark.sql import functions as F

from newsmill.streaming import circuit


def _rows(n=300):
    rnd = random.Random(3)
    return [(f"d{rnd.randrange(4)}", i, 1_700_000_000 + i * rnd.randrange(1, 900) // 2, rnd.choice([200, 429, 429, 403, 403, 403, 500]), rnd.choice([None, 5.0, 120.0, 100_000.0])) for i in range(n)]


SCHEMA = "domain string, id long, ts long, status int, wait double"


def _brute(rows):
    state = {}
    for d, i, ts, status, wait in sorted(rows, key=lambda r: (r[2], r[1])):
        state[d] = circuit.step(state.get(d, ("CLOSED", 0, 0, None)), ts, status, wait)
    return {k: tuple(v) for k, v in state.items()}


def test_fold_is_the_transition(spark):
    rows = _rows()
    got = {r.domain: (r.circuit, r.n429, r.n403, r.cooldown_until) for r in circuit.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)


def test_stream_is_the_fold(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: (r[2], r[1]))
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    last = {}

    def keep(df, _):
        last.update({r.domain: (r.circuit, r.n429, r.n403, r.cooldown_until) for r in df.collect()})

    q = circuit.stream(src).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    assert last == _brute(rows)


def test_activity_stream_is_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "view" if m % 2 else "click", 1.0) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    q = circuit.activity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("act")) == key(circuit.activity(df))
