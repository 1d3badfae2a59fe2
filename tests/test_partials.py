"""Mention partials when a compacting batch is run again after a restart."""

from tickloom.streaming import jobs


def test_replay_of_a_compacting_batch_keeps_earlier_hours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "run", lambda stream, each, *rest: each)
    monkeypatch.setattr(jobs, "mention_partial_stream", lambda posts, late: posts)
    path = str(tmp_path / "partials")
    publish = jobs.mention_partials(None, path, "unused", compact_every=2)
    batches = [[("h1", 1), ("h2", 1)], [("h2", 5), ("h3", 1)], [("h3", 4)], [("h4", 1)]]
    want = {}
    for k, rows in enumerate(batches):
        want |= dict(rows)
        table = spark.createDataFrame([(h, "s", "a", n) for h, n in rows], "hour string, source string, symbol string, mentions long")
        for _ in range(2):
            publish(table, k)
            assert {r.hour: r.mentions for r in jobs.current_partials(spark, path).collect()} == want
    assert jobs.published_versions(spark, path) == [3]
