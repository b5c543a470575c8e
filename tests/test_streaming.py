import shutil

from pyspark.sql import functions as F

from engramlake.streaming import messages as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def files(spark, folder, copies):
    x = spark.read.parquet(EVENTS)
    for k in range(copies):
        x.coalesce(1).write.parquet(f"{folder}/{k}")
    (flat := folder / "flat").mkdir()
    for k in range(copies):
        for p in (folder / str(k)).glob("*.parquet"):
            shutil.copy(p, flat / f"{k}-{p.name}")
    return str(flat), x


def test_each_event_once_however_often_it_is_sent(spark, tmp_path):
    path, x = files(spark, tmp_path, 2)
    stream = S.deduplicated(S.read(spark, path, x.schema, 2), late="60 days")
    S.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == x.select("event_id").distinct().count()


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    path, x = files(spark, tmp_path, 1)
    S.drain(S.sessions(S.read(spark, path, x.schema), "user_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    at = x.withColumn("at", F.col("ts").cast("timestamp"))
    batch = at.groupBy(F.session_window("at", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("messages"))
    batch = batch.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")
    assert got.count() >= 0.9 * batch.count() and got.join(batch, got.columns, "left_anti").count() == 0


def test_blocks_of_a_stream_equal_those_of_the_table_late_messages_included(spark):
    from engramlake import queries as own

    found = own.queries()
    got = found["stream_blocks"](spark, "/root/testdata/sf0.001")
    want = found["blocks_full"](spark, "/root/testdata/sf0.001").select(*got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0
