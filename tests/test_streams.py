from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulseloom.streaming.upsert import ext_stream_upsert, run_stream, upserted

T0 = datetime(2026, 4, 14, 9)
ROW = "instrument_id string, ts timestamp, observed_at long, seq long, price double"


def at(minutes, observed, seq, price, who="a"):
    return (who, T0 + timedelta(minutes=minutes), observed, seq, price)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def state(spark, folder):
    rows = upserted(spark, f"{folder}/out").withColumn("hour", F.date_format("hour", "dd HH")).collect()
    return {(r.instrument_id, r.hour): (r.price, r.seq, r.replaced, r.closed, r.late) for r in rows}


def test_upsert_restarts_where_it_stopped(spark, tmp_path):
    """The newest observation wins over batches and restarts, closed bars stay, late rows are counted, and a whole run gives the same as two."""
    first = [at(5, 1, 0, 10.0), at(6, 3, 1, 11.0), at(7, 2, 2, 12.0), at(8, 3, 3, 13.0), at(5, 1, 4, 20.0, "b")]
    second = [at(10, 9, 5, 14.0), at(24 * 60, 1, 6, 30.0)]
    third = [at(11, 99, 7, 15.0), at(12, 99, 8, 16.0, "c"), at(24 * 60 + 1, 5, 9, 31.0)]
    want = {("a", "14 09"): (14.0, 5, 2, True, 1), ("b", "14 09"): (20.0, 4, 0, True, 0), ("c", "14 09"): (None, None, None, None, 1), ("a", "15 09"): (31.0, 9, 1, False, 0)}
    results = []
    for runs in ([[first, second, third]], [[first, second], [third]], [[first], [second], [third]]):
        folder = tmp_path / str(len(results))
        for files in runs:
            for rows in files:
                feed(spark, folder, rows)
            s = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            run_stream(ext_stream_upsert(s), f"{folder}/out", f"{folder}/checkpoint")
        results.append(state(spark, folder))
    assert results == [want] * 3
    # nothing new: nothing changes
    s = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_stream(ext_stream_upsert(s), f"{folder}/out", f"{folder}/checkpoint")
    assert state(spark, folder) == want
