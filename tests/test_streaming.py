"""Votes of a stream: late and repeated rows, several batches, a restart."""

from collections import defaultdict
from datetime import datetime, timedelta

from chromalith.streaming import votes

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, chrom string, cell_id string, b int"


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


BATCHES = [
    # first hour, with repeats in the batch
    [(5, "chr1", "c1", 3), (6, "chr1", "c1", 3), (7, "chr1", "c2", 3), (50, "chr2", "c1", 3), (59, "chr1", "c3", 9)],
    # repeats of the first hour out of order but in time; the second hour
    [(20, "chr1", "c1", 3), (30, "chr1", "c3", 3), (65, "chr1", "c1", 3), (100, "chr1", "c1", 3)],
    # moves the watermark to 4:00
    [(270, "chr1", "c9", 1)],
    # late: its hour has been given out
    [(10, "chr1", "c7", 3), (275, "chr1", "c8", 1), (276, "chr1", "c9", 1)],
    # ends what is open
    [(2000, "chr9", "z", 0)],
    [(2001, "chr9", "z", 0)],
]


def test_votes_of_a_stream_equal_the_batch(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        with votes.rocksdb(spark):
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            q = votes.vote_stream(stream, "1 hour", "30 minutes").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination()

    for rows in BATCHES:  # each run starts anew from the checkpoint
        spark.createDataFrame([(_at(m), *rest) for m, *rest in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    late = (_at(10), "chr1", "c7", 3)
    kept = [(_at(m), *rest) for rows in BATCHES[:-2] for m, *rest in rows if (_at(m), *rest) != late]
    want = votes.vote_batch(spark.createDataFrame(kept, SCHEMA))
    assert got == sorted(tuple(r) for r in want.collect())
    plain = defaultdict(set)
    for ts, chrom, cell, b in kept:
        plain[ts.replace(minute=0), chrom, b].add(cell)
    assert {(r[0], r[2], r[3]): r[4] for r in got} == {k: len(v) for k, v in plain.items()}


def test_votes_without_rows_or_with_nulls(spark):
    df = spark.createDataFrame([(None, "chr1", "c", 1), (_at(1), None, "c", 1), (_at(1), "chr1", None, 1), (_at(1), "chr1", "c", None)], SCHEMA)
    assert votes.vote_batch(df).count() == 0


def test_a_vote_behind_the_watermark_counts_while_its_window_is_open(spark, tmp_path):
    """Votes are dropped and counted by Spark's own state, without a call of Python for each key; what is late is told by the window."""
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    names = []
    for rows in ([(50, "chr1", "c1", 3)], [(51, "chr1", "c1", 3)], [(20, "chr1", "c2", 3), (20, "chr1", "c2", 3)], [(500, "chr1", "c1", 3)]):
        spark.createDataFrame([(_at(m), *rest) for m, *rest in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with votes.rocksdb(spark):
            q = votes.vote_stream(spark.readStream.schema(SCHEMA).parquet(source), "1 hour", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination()
        names = [s["operatorName"] for s in q.lastProgress["stateOperators"]]
    assert [(r.b, r.votes) for r in spark.read.parquet(out).collect()] == [(3, 2)]
    assert sorted(names) == ["dedupe", "stateStoreSave"]
