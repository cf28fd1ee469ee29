"""The limiter's stream over several micro-batches against the batch fold and sessions counted by hand."""

from pyspark.sql import functions as F

from envsense.operators import detect
from envsense.sources import tables
from envsense.streaming import limits
from tests.conftest import SF


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.ROCKS)
    p = tables.packets(spark, SF).select("device_id", "ts", "seq").where("device_id < 4").persist()
    cuts = p.selectExpr("percentile(unix_micros(ts), array(0.3, 0.7))").first()[0]
    us = F.unix_micros("ts")
    parts = [p.where(us < cuts[0]), p.where((us >= cuts[0]) & (us < cuts[1])), p.where(us >= cuts[1])]
    # One packet arrives a batch too late; the last batch moves the watermark past all sessions.
    tardy = parts[0].orderBy("ts").limit(1)
    parts[0], parts[1] = parts[0].join(tardy, "seq", "left_anti").select("device_id", "ts", "seq"), parts[1].union(tardy)
    end = spark.createDataFrame([(99, 10**6)], "device_id long, seq long").select("device_id", F.expr("timestamp '2030-01-01'").alias("ts"), "seq")
    for k, part in enumerate([*parts, end]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = limits.limited_stream(stream, rate=1 / 86400, most=3, gap="1000 days", late="400 days")
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.table("limited").where("device_id <> 99").collect()
    got = {r.seq: r for r in rows if r.kind == "packet"}
    late = tardy.first()
    owner = p.where(F.col("device_id") == late.device_id).where("seq <> " + str(late.seq))
    assert got[late.seq].error == limits.LATE and got[late.seq].tokens is None
    given = p.where(F.col("device_id") != late.device_id).union(owner).withColumn("us", us)
    want = {r.seq: r for r in detect.token_bucket(given, ["device_id"], "us", ["us", "seq"], 1 / 86400, 3).collect()}
    assert got.keys() - {late.seq} == want.keys() and len(want) > 20
    for k, r in want.items():
        assert abs(got[k].tokens - r.tokens) < 1e-9 and got[k].error == r.error
    assert {r.error for r in want.values()} == {None, "RATE_LIMIT_EXCEEDED"}
    ended = {r.device_id: r for r in rows if r.kind == "session"}
    for d in {r.device_id for r in want.values()}:
        mine = sorted(r.us for r in want.values() if r.device_id == d)
        errors = sum(r.error is not None for r in want.values() if r.device_id == d) + (d == late.device_id)
        assert (ended[d].accepted, ended[d].rejected, ended[d].us, ended[d].recent) == (len(mine) - errors + (d == late.device_id), errors, mine[-1], mine[-5:])
