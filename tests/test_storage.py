import os

from quarry import storage


def test_tables_are_written_and_dropped(spark):
    start = storage.mark()
    a, b = (storage.written(spark.range(n), "t") for n in (3, 5))
    keep = storage.last()
    folders = [p.removeprefix("file://") for _, p in storage._made[start:]]
    assert [a.count(), b.count()] == [3, 5] and all(map(os.path.isdir, folders))
    storage.drop(start, keep=keep)
    assert [os.path.isdir(f) for f in folders] == [False, True] and b.count() == 5
    storage.drop(start)
    assert not os.path.isdir(folders[1]) and storage.mark() == start
