"""A streamed table ends as the batch table."""

from biotally.operators.alpha import naive_alpha
from biotally.plans import fixtures as fx
from biotally.streaming import counts

SF = "/root/testdata/sf0.001"


def test_running_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        events.where(f"abs(hash(user_id, event_type)) % 3 = {k}").write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = counts.running_table(stream, "event_type", "user_id").writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("running").collect()}
    assert got == {tuple(r) for r in fx.tab_events(spark, SF).collect()}


def test_windowed_alpha_is_naive(spark):
    rows = spark.createDataFrame([("w", "a", "s", 3.0), ("w", "b", "s", 5.0)], "start string, feature string, sample string, value double")
    for q in (0, 1, 2):
        assert abs(counts.windowed_alpha(rows, q).first()["d"] - naive_alpha(rows, q).first()["d"]) < 1e-12
