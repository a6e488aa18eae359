"""Real files that are made, changed, moved and removed come out as events, over restarts."""

import os

from quarry.sources import watcher
from quarry.streaming import ingest


def test_files_become_events(spark, tmp_path):
    root, kept, events, table = (tmp_path / x for x in ("project", "seen", "events", "table"))
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    events.mkdir()

    def put(name, text, at_s):
        (root / name).write_text(text)
        os.utime(root / name, (at_s, at_s))

    def look(number, now_s):
        rows = watcher.look(spark, str(root), str(kept), str(events), number, now_s * 1000, 500)
        return {(r.path, r.kind) for r in rows.collect()}

    put("src/a.rs", "one", 100)
    put("src/b c.rs", "two", 100)
    put("node_modules/x.js", "no", 100)
    put("src/fresh.rs", "still being written", 200)
    assert look(1, 200) == {("src/a.rs", "created"), ("src/b c.rs", "created")}
    assert look(2, 201) == {("src/fresh.rs", "created")}
    assert look(3, 202) == set()
    put("src/a.rs", "more", 300)
    put("src/a.rs", "mor2", 301)  # two writes, one event
    (root / "src/fresh.rs").unlink()
    assert look(4, 400) == {("src/a.rs", "modified"), ("src/fresh.rs", "deleted")}
    assert look(4, 400) == {("src/a.rs", "modified"), ("src/fresh.rs", "deleted")}  # run again after a failure
    (root / "lib").mkdir()
    (root / "src/a.rs").rename(root / "lib/a.rs")
    assert look(5, 500) == {("src/a.rs", "deleted"), ("lib/a.rs", "created")}
    assert {r.path for r in watcher.seen(spark, str(kept)).collect()} == {"lib/a.rs", "src/b c.rs"}

    batch = spark.read.schema(ingest.EVENTS).option("recursiveFileLookup", True).json(str(events))
    moved = ingest.normalize(batch.where("batch = 5")).collect()
    assert [(r.kind, r.path, r.from_path) for r in moved] == [("renamed", "lib/a.rs", "src/a.rs")]
    stream = ingest.upsert_stream(ingest.file_events(spark, str(events)), str(table), str(tmp_path / "checkpoint")).start()
    assert stream.awaitTermination(60)
    assert {r.path for r in ingest.buckets.latest(spark, str(table)).collect()} == {"lib/a.rs", "src/b c.rs"}
