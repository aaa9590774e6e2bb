"""Counter tables of streams: bounded reading, replay, and the gate's state."""
import random

from pyspark.sql import functions as F

from revlens.operators import spam
from revlens.streaming import deltas, gate, stream


def test_files_read_stay_bounded(spark, tmp_path):
    table, merge = str(tmp_path / "t"), deltas.sums(("key",), ("c",))
    for epoch in range(40):
        deltas.publish(spark.createDataFrame([("a", 1), (f"k{epoch % 3}", 2)], "key string, c long").coalesce(1), table, epoch, merge, every=6)
        _, base, after = deltas.parts(spark, table)
        assert len(after) < 6
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("epoch=")]) <= 12
    assert len(list((tmp_path / "t" / "_base").glob("upto=*"))) <= 2
    got = {r.key: r.c for r in deltas.read(spark, table, merge).collect()}
    assert got == {"a": 40, "k0": 28, "k1": 26, "k2": 26}


def test_repeated_epochs_count_once(spark, tmp_path):
    table, merge = str(tmp_path / "t"), deltas.sums(("key",), ("c",))
    for epoch in (0, 1, 1, 2, 2, 0, 3, 3, 1):  # also some that a base has taken in
        deltas.publish(spark.createDataFrame([("a", 10**epoch)], "key string, c long"), table, epoch, merge, every=3)
    assert deltas.read(spark, table, merge).first().c == 1111


def test_a_base_without_commit_is_not_read(spark, tmp_path):
    table, merge = str(tmp_path / "t"), deltas.newest_wins(("key",))
    for epoch in range(5):
        deltas.publish(spark.createDataFrame([("a", epoch)], "key string, c long"), table, epoch, merge, every=3)
    newest = max((tmp_path / "t" / "_base").glob("upto=*"))
    assert newest.name == "upto=2" and deltas.read(spark, table, merge).first().c == 4
    (newest / "_SUCCESS").unlink()  # as if the compaction had died: its deltas are still there
    assert deltas.parts(spark, table)[1] is None and deltas.read(spark, table, merge).first().c == 4


def test_gate_state_equals_the_batch_gate(spark, tmp_path):
    """Counters of any split, in any order, repeated or not, give the bounds and the
    estimate of all rows at once."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "y", None]), " ".join(rng.choice("abc") for _ in range(rng.randrange(14))) if i % 17 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    table, add = str(tmp_path / "g"), None
    add = gate.publish(table, every=2)
    for epoch in (0, 1, 2, 2, 1, 3):
        add(df.where(F.col("review_id") % 4 == epoch), epoch)
    got = sorted(map(str, gate.current_gate(spark, table).collect()))
    whole = sorted(map(str, gate.gate_from_counters(gate.gate_counters(df)).collect()))
    assert got == whole
    full = {r.batch: r for r in spam.spam_gate(df.where("reviews is not null")).collect()}
    for r in gate.current_gate(spark, table).collect():
        assert (r.n, r.avg_ttr) == (full[r.batch].n, full[r.batch].avg_ttr)
        if r.decided_by != "estimate":
            assert r.is_spam == full[r.batch].is_spam and r.decided_by == full[r.batch].decided_by


def test_csv_stream_reads_as_the_batch_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('review_id,batch,reviews\n1,h,"The nurses were kind"\n2,h,NA\n3,h,"a ""quoted"", text"\n')
    sink = str(tmp_path / "out")
    stream.start_prediction_query(spark, str(tmp_path / "in"), sink, fmt="csv", checkpoint=str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    assert sorted((r.review_id, r.reviews) for r in spark.read.parquet(sink).collect()) == [(1, "The nurses were kind"), (3, 'a "quoted", text')]
