"""Streamed batches keep the parallelism of their rows."""

from pyspark.sql import functions as F

from vaultspark.plans.vault import _event_batches


def test_a_batch_of_several_files_is_one_micro_batch_in_order(spark, tmp_path):
    events = spark.createDataFrame([(i,) for i in range(900)], "event_id long").repartition(4)
    events.write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def handle(rows, batch):
        ids, files = zip(*rows.collect())
        seen.append((batch, min(ids), max(ids), len(ids), len(set(files))))

    _event_batches(spark, str(tmp_path), 3, handle, "event_id", F.input_file_name())
    assert [s[:4] for s in seen] == [(0, 0, 299, 300), (1, 300, 599, 300), (2, 600, 899, 300)]
    assert all(s[4] > 1 for s in seen)
