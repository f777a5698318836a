"""Runs of a bucket share a key of state: calls out of Python grow with the buckets of a batch, not with its runs."""

import datetime
import json

from quire.session import shared_folder
from quire.streaming import follow


def test_state_has_a_row_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(follow, "BUCKETS", 8)
    # in the order of time: every third run ends; 0 to 99 come a week before the others, which leaves them alone
    line = lambda i: json.dumps({"type": "end" if i % 3 == 0 else "log", "spent": i}) + "\n"
    rows = [(str(i), 1, datetime.datetime(2024, 1, 1 if i < 100 else 8, 0, 0, i % 60), line(i)) for i in range(400)]
    folder, schema = shared_folder(spark), "run string, seq long, ts timestamp, piece string"
    for part in (rows[:100], rows[100:250], rows[250:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    seen, store = [], "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = follow.follow(live, 3600).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    finally:
        spark.conf.set(store, before)
    last = {r.run: (r.status, r.lines) for r in seen}
    assert last == {str(i): ("done", 0) if i % 3 == 0 else ("left" if i < 100 else "running", 1) for i in range(400)}
    assert 0 < max(kept) <= 4 * 8  # values, and timers by key and by time
    assert sum(r.more for r in seen) == sum(range(400))
