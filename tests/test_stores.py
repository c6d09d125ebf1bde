"""Published versions under several writers, and the store that follows a feed."""

import json
import random
import threading

import pytest

from pyspark.sql import functions as F

from railweave.sources import stores, versions
from railweave.streaming import feed

SCHEMA = "id bigint, seq bigint, payload string, origin string, cleared boolean"
FIELDS = ("id", "seq", "payload", "origin", "cleared")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_versions(spark, tmp_path):
    path, frame = str(tmp_path / "v"), spark.range(3)
    assert versions.current(spark, path) is None and versions.current(spark, path, frame).count() == 3 and not versions.clear(spark, path)
    assert versions.publish(frame, path) == 0 and versions.publish(versions.current(spark, path).where("id > 0"), path) == 1
    versions.written(frame, path)  # written but not told: does not count
    assert versions.current(spark, path).count() == 2
    assert versions.clear(spark, path) and not versions.clear(spark, path) and versions.current(spark, path).count() == 0
    assert stores.store_or_default(spark, path, frame).count() == 0
    assert versions.drop_old(spark, path, keep=1) == 2 and versions.current_version(spark, path) == 2
    (tmp_path / "broken" / "commits").mkdir(parents=True)
    (tmp_path / "broken" / "commits" / f"{0:020d}.json").write_text("no JSON")
    with pytest.raises(ValueError):
        stores.store_or_default(spark, str(tmp_path / "broken"), frame)


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    path = str(tmp_path / "v")
    versions.publish(spark.range(1), path)
    seen = versions.current_version(spark, path)
    assert versions.publish(spark.range(5), path, after=seen) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(9), path, after=seen)
    assert versions.current(spark, path).count() == 5
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 1, {"data": []})


def test_changes_of_all_writers_are_kept(spark, tmp_path):
    """Six writers at a time, each adding rows to what it sees."""
    path, faults = str(tmp_path / "v"), []
    versions.publish(spark.range(1).selectExpr("id - 1 AS id"), path)

    def write(k):
        try:
            for j in range(2):
                versions.change(spark, path, lambda now: now.unionByName(spark.range(1).select(F.lit(10 * k + j).cast("bigint").alias("id"))))
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not faults
    assert rows(versions.current(spark, path), "id") == sorted([(-1,)] + [(10 * k + j,) for k in range(6) for j in range(2)], key=str)
    assert versions.current_version(spark, path) == 12


def ran(spark, folder, name, changes, store, a_file=10, **more):
    """Runs a stream over `changes`, so many to a file and one file to a batch."""
    (folder / name).mkdir(exist_ok=True)
    for at in range(0, len(changes), a_file):
        (folder / name / f"{at:06d}.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, c))) for c in changes[at : at + a_file]))
    live = feed.change_feed(spark, str(folder / name), SCHEMA, files_per_trigger=1).where(feed.from_others("me"))
    query = feed.follow(live, store, str(folder / f"{name}-checkpoint"), **more)
    query.awaitTermination(300)
    assert query.exception() is None


def wanted(spark, changes):
    return rows(feed.replayed(spark.createDataFrame(changes, SCHEMA).where(feed.from_others("me"))), "id", "seq", "payload", "position")


def test_stream_equals_batch(spark, tmp_path):
    """All columns over several batches, a second stream with a new checkpoint, clearings, and rows that come after them though they are older."""
    out, seen = str(tmp_path / "out"), []
    now = lambda: rows(feed.latest(spark, out), "id", "seq", "payload", "position")
    changes = [(k % 5 if k % 9 else None, k, f"p{k}", "me" if k % 7 == 0 else None, None) for k in range(1, 40)]
    assert feed.latest(spark, out) is None
    ran(spark, tmp_path, "a", changes, out, changed=lambda keys: seen.append({r[0] for r in keys.collect()}))
    assert now() == wanted(spark, changes) and seen[0] == {0, 1, 2, 3, 4}
    more = [(k % 7, k, f"q{k}", None, None) for k in range(40, 55)]
    ran(spark, tmp_path, "b", more, out)  # the store that is there is respected
    assert now() == wanted(spark, changes + more)
    # A clearing, then in a later batch rows from before it and after it, then one that comes late itself.
    late = [(None, 60, None, None, True), (9, 61, "after", None, None), (1, 59, "late", None, None), (9, 64, "newer", None, None), (8, 63, "x", None, None), (None, 62, None, None, True), (2, 62, "at the mark", None, None)]
    ran(spark, tmp_path, "c", late, out, a_file=1)
    assert now() == wanted(spark, changes + more + late) == [(8, 63, "x", 63), (9, 64, "newer", 64)]
    # Under a new checkpoint the mark is still known.
    last = [(3, 61, "too late", None, None), (4, 70, "fine", None, None)]
    ran(spark, tmp_path, "d", last, out)
    assert now() == wanted(spark, changes + more + late + last)
    assert len(list((tmp_path / "out" / "commits").glob("*.json"))) == 2


def test_shuffled_changes_equal_the_batch(spark, tmp_path, monkeypatch):
    """Changes in any order, with several clearings, and parts that are joined now and then."""
    monkeypatch.setattr(feed, "COMPACT", 2)
    random.seed(6)
    changes = [(random.randrange(12), k, f"p{k}", None, False) for k in range(80)]
    for k in (20, 55):
        changes[k] = (None, k, None, None, True)
    random.shuffle(changes)
    out = str(tmp_path / "out")
    ran(spark, tmp_path, "a", changes, out, a_file=16)
    assert rows(feed.latest(spark, out), "id", "seq", "payload", "position") == wanted(spark, changes)
    assert len(versions.head(spark, out)[1]["data"]) <= 3


def test_a_batch_that_runs_again_is_added_once(spark, tmp_path):
    """The job dies after its commit: the batch runs again from the old checkpoint, and the store is as before."""
    out, changes = str(tmp_path / "out"), [(k % 3, k, f"p{k}", None, None) for k in range(6)]

    def die(keys):
        raise RuntimeError("dies after the commit")

    with pytest.raises(Exception, match="dies after"):
        ran(spark, tmp_path, "a", changes, out, changed=die)
    before = versions.head(spark, out)
    ran(spark, tmp_path, "a", changes, out)
    assert versions.head(spark, out) == before and rows(feed.latest(spark, out), "id", "seq", "payload", "position") == wanted(spark, changes)


LOG = "type string, id bigint, at timestamp, seq bigint"


def heard(spark, folder, log, *more, **options):
    """Runs a stream over the log, and again after each of `more` is added to it; the numbers and ids of each batch."""
    from railweave.streaming.log import append, change_log

    batches = []
    query = change_log(spark, log, LOG, **options).writeStream.foreachBatch(lambda b, n: batches.append(sorted(tuple(r) for r in b.select("seq", "id").collect()))).option("checkpointLocation", str(folder / "checkpoint")).start()
    try:
        query.processAllAvailable()
        for changes in more:
            append(spark, log, changes)
            query.processAllAvailable()
    finally:
        query.stop()
    return [b for b in batches if b]


def test_the_log_is_read_once_in_parts(spark, tmp_path):
    """A stream that is stopped and started loses nothing and repeats nothing; a later batch takes no more than it may."""
    from railweave.streaming import log

    path = str(tmp_path / "log")
    assert log.last_number(path) == -1
    assert [log.append(spark, path, [{"type": "store-changed", "id": k, "at": "2026-07-03T10:00:00"} for k in range(n)]) for n in (3, 1)] == [0, 3]
    first = heard(spark, tmp_path, path, [{"id": k} for k in range(7)], max_changes=3)
    assert [[seq for seq, _ in b] for b in first] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    assert log.append(spark, path, [{"id": 70}, {"id": 71}]) == 11
    assert heard(spark, tmp_path, path) == [[(11, 70), (12, 71)]]
    assert heard(spark, tmp_path, path) == []
    with pytest.raises(ValueError):
        log.append(spark, path, [])


def test_writers_of_the_log_get_numbers_of_their_own(spark, tmp_path):
    from railweave.streaming import log

    path, got, faults = str(tmp_path / "log"), [], []

    def write(k):
        try:
            for j in range(4):
                got.append((log.append(spark, path, [{"id": 100 * k + j}, {"id": 100 * k + j}]), 100 * k + j))
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not faults and sorted(first for first, _ in got) == list(range(0, 40, 2))
    (batch,) = heard(spark, tmp_path, path)
    assert batch == sorted((first + k, i) for first, i in got for k in (0, 1))
