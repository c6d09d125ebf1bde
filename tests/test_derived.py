"""Counts by signed changes against counting everything anew, batch by batch."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from railweave.checkpoints import stored
from railweave.streaming import derived, feed

SCHEMA = "id bigint, seq bigint, date string, segments array<string>, cleared boolean"


def told(frame, by):
    return {r[by]: r["n"] for r in frame.collect()}


def test_twenty_batches(spark):
    """Trains come, change, keep their rows, and go; after each batch both counts are those of the whole store."""
    rng = random.Random(3)
    schema = "id int, date string, segments array<string>"
    store, dates, shared = {}, None, None
    before = None
    for batch in range(20):
        keys = {rng.randrange(15) for _ in range(4)} if batch != 12 else set(store)
        for k in keys:
            if batch == 12 or rng.random() < 0.2:
                store.pop(k, None)
            elif rng.random() < 0.8:
                store[k] = (rng.choice(["2026-07-01", "2026-07-02", "undated", None]), [rng.choice("abcdef") for _ in range(rng.randrange(5))])
        after = spark.createDataFrame([(k, *v) for k, v in store.items()], schema)
        rows = stored(derived.signed(before, after, spark.createDataFrame([(k,) for k in keys], "id int")))
        assert {r["id"] for r in rows.collect()} <= keys
        dates = stored(derived.applied(dates, derived.date_changes(rows), "date"))
        shared = stored(derived.applied(shared, derived.segment_changes(rows), "seg_key"))
        assert told(dates, "date") == Counter(d for d, _ in store.values())
        assert told(shared, "seg_key") == Counter(s for _, segments in store.values() for s in set(segments))
        before = after


def test_with_the_store_of_a_feed(spark, tmp_path):
    """The keys that a batch tells are enough to keep counts, also where it clears the store; then the default counts."""
    out, seen = str(tmp_path / "store"), []
    counts = {"before": None, "dates": None}

    def follow_counts(keys):
        now = stored(feed.latest(spark, out).select("id", "date", "segments"))
        rows = derived.signed(counts["before"], now, keys)
        counts["dates"] = stored(derived.applied(counts["dates"], derived.date_changes(rows), "date"))
        counts["before"] = now
        seen.append((told(counts["dates"], "date"), Counter(r["date"] for r in now.where("id IS NOT NULL").collect())))

    changes = [(k % 4, k, f"d{k % 3}", ["s"], None) for k in range(1, 9)] + [(None, 9, None, None, True)]
    (tmp_path / "in").mkdir()
    for at in range(0, 9, 4):
        (tmp_path / "in" / f"{at}.json").write_text("\n".join(json.dumps(dict(zip(("id", "seq", "date", "segments", "cleared"), c))) for c in changes[at : at + 4]))
    query = feed.follow(feed.change_feed(spark, str(tmp_path / "in"), SCHEMA, 1), out, str(tmp_path / "checkpoint"), changed=follow_counts)
    query.awaitTermination(300)
    assert query.exception() is None and len(seen) == 3
    assert all(kept == anew for kept, anew in seen) and seen[1][0] and seen[2][0] == {}
    default = spark.createDataFrame([(1, "d")], "id bigint, date string")
    assert derived.or_default(feed.latest(spark, out), default).count() == 1 and derived.or_default(None, default).count() == 1
    assert derived.or_default(default.withColumn("id", F.lit(5)), default).first()["id"] == 5
