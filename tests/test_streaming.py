from datetime import datetime

from attestlake.streaming import events

SF = "/root/testdata/sf0.001"


def test_all_batches_give_the_table(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=2)
    for _ in range(2):  # the second run finds nothing new
        events.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("event_id", "user_id")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in rows.collect())


def test_new_content_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, "a", at), (2, "a", at), (3, None, at), (4, "", at), (5, "b", at)], "id int, text string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.new_content(events.read_stream(spark, str(tmp_path / "in"), rows.schema), "text", "at")
    events.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.text or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "a", "b"]


def test_cursor_states_verdicts(spark):
    log = spark.createDataFrame([(1, "j", "queued"), (2, "j", "running"), (3, "k", "queued"), (4, "j", "ready")], "id int, job string, state string")
    assert [r.id for r in events.after_cursor(log, "id", 1, 2).collect()] == [2, 3]
    assert {(r.job, r.state, r.n) for r in events.current_state(log, "job", "id", "state").collect()} == {("j", "ready", 3), ("k", "queued", 1)}
    claims = spark.createDataFrame([(1,), (2,)], "claim int")
    found = spark.createDataFrame([(1, "verified"), (1, "altered")], "claim int, verdict string")
    assert {(r.claim, r.verdict) for r in events.verdicts(claims, found, "claim", "verdict").collect()} == {(1, "altered"), (2, "could_not_check")}


def test_mastery_over_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "up"), (3, "a", "down"), (2, "a", "up"), (1, "b", "odd"), (1, None, "up")], "seq int, key string, kind string")
    more = spark.createDataFrame([(4, "a", "up"), (2, "b", None)], rows.schema)
    (tmp_path / "in").mkdir()
    stream = events.mastery(events.read_stream(spark, str(tmp_path / "in"), rows.schema), "key", "seq", "kind", {"up": 0.4, "down": -0.3}, -0.05)
    for part in (rows, more):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    last = {r.key: (r.mastery, r.n) for r in sorted(out, key=lambda r: r.n)}
    assert last == {"a": (1.0, 4), "b": (0.4, 2), None: (0.9, 1)}


def test_unfinished_jobs(spark):
    log = spark.createDataFrame([(1, "j", "queued"), (2, "j", "running"), (3, "k", "queued"), (4, "k", "ready")], "id int, job string, state string")
    assert [(r.job, r.id) for r in events.unfinished(log, "job", "id", "state").collect()] == [("j", 2)]
