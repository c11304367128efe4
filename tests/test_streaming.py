import datetime as dt
import json

from pyspark.sql import functions as F

from fieldlark.sources.readers import checked_csv, file_digests
from fieldlark.sources.writers import current_table, export_csv
from fieldlark.streaming.sync import accepted_fixes, record_stream, sync


def test_sync_is_idempotent(spark, tmp_path):
    src, target, dead = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "dead")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in [{"k": 1, "v": "a", "t": 1}, {"k": 1, "v": "b", "t": 2}, {"k": None, "v": "x", "t": 1}]))
    stream = lambda: record_stream(spark, str(src), "k int, v string, t int")
    for c in ("c1", "c2"):
        sync(stream(), target, str(tmp_path / c), ["k"], "t", F.col("k").isNotNull(), dead).awaitTermination()
        assert [(r.k, r.v) for r in current_table(spark, target).collect()] == [(1, "b")]
    assert spark.read.parquet(dead).count() == 1


def test_spacing_counts_from_the_last_accepted(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("s", t + dt.timedelta(seconds=s)) for s in (0, 0.6, 1.2, 1.8, 2.4)]
    got = accepted_fixes(spark.createDataFrame(rows, "s string, ts timestamp"), "s", 1.0).orderBy("ts").collect()
    assert [(r.ts - t).total_seconds() for r in got] == [0, 1.2, 2.4]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,\n2,x\n".encode())
    df = checked_csv(spark, str(tmp_path / "a.csv"), ["id"])
    assert [(r.id, r.name) for r in df.collect()] == [("1", None), ("2", "x")]
    for text, required in [("id,id\n1,2\n", ["id"]), ("id\n1\n", ["other"]), ("", ["id"])]:
        (tmp_path / "b.csv").write_text(text)
        try:
            checked_csv(spark, str(tmp_path / "b.csv"), required)
        except ValueError:
            continue
        raise AssertionError(text)
    assert len(file_digests(spark, str(tmp_path / "a.csv")).first()["sha256"]) == 64
    export_csv(spark.createDataFrame([(1, ["a", "b"], 'say "x"')], "i int, l array<string>, s string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()["l"] == "a, b"


def test_capture_sessions_end_by_count_and_by_time(spark, tmp_path):
    import datetime as dt
    import json

    from fieldlark.streaming import sync

    folder, day = tmp_path / "fixes", dt.datetime(2026, 7, 1)
    folder.mkdir()

    def put(name, rows):
        (folder / f"{name}.json").write_text("\n".join(json.dumps({"s": s, "ts": (day + dt.timedelta(seconds=t)).isoformat(), "accuracy": a}) for s, t, a in rows))

    put("1", [("a", 0, 5), ("a", 1, 50), ("b", 0, 5), ("c", 5, None)])
    fixes = spark.readStream.schema("s string, ts timestamp, accuracy double").option("maxFilesPerTrigger", 1).json(str(folder))
    q = sync.captures(fixes, "s", 2, 10.0, 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
    for name, rows in [("2", [("a", 3, 9), ("a", 4, 1), ("b", 20, 90)]), ("3", [("d", 300, 1)]), ("4", [("d", 301, 70), ("e", 900, 1)]), ("5", [("e", 1900, 1)])]:
        q.trigger(availableNow=True).start().awaitTermination()
        put(name, rows)
    q.trigger(availableNow=True).start().awaitTermination()
    got = {r.session: (r.n_fixes, r.n_good, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"] == (3, 2, "enough") and got["b"] == (2, 1, "timeout") and got["c"] == (1, 0, "timeout") and got["d"] == (2, 1, "timeout")
    whole = spark.read.schema("s string, ts timestamp, accuracy double").json(str(folder))
    batch = {r.session: (r.n_fixes, r.n_good, r.reason) for r in sync.captures(whole, "s", 2, 10.0, 60.0).collect()}
    assert {k: batch[k] for k in "abcd"} == {k: got[k] for k in "abcd"}
