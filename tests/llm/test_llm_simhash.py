"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import xxhash
from helpers import ODD, plain, real, table
from pyspark.sql import functions as F

from railweave.llm import simhash
from railweave.llm.components import connected_components
from railweave.llm.durable import checkpointed


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    """Least member of each member's group, over all pairs."""
    least = {p: p for p in prints}
    changed = True
    near = {p: [q for q in prints if (p ^ q).bit_count() <= radius] for p in prints}
    while changed:
        changed = False
        for p in prints:
            m = min(least[q] for q in near[p])
            if m < least[p]:
                least[p], changed = m, True
    return least


def test_groups_equal_all_pairs(spark):
    random.seed(1)
    texts = [r[0] for r in plain(real(spark), "text")][:150] + ODD
    texts += [t.replace(" the ", " a ", 1) for t in texts[:40] if t]
    docs = table(spark, texts)
    got = plain(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id")
    prints = [brute_print(t) for t in texts]
    least = brute_groups(sorted(set(prints)))
    ids = {}
    for k, p in enumerate(prints):
        ids[least[p]] = min(k, ids.get(least[p], k))
    want = [(k, f"{p:016x}", ids[least[p]]) for k, p in enumerate(prints)]
    want.append((None, *want[-1][1:]))
    assert sorted(got, key=str) == sorted(want, key=str)


def _family(size, seed):
    """Fingerprints near each other and far ones, signed."""
    random.seed(seed)
    out = set()
    for _ in range(size // 20):
        at = random.getrandbits(64)
        for _ in range(20):
            for _ in range(random.randrange(4)):
                at ^= 1 << random.randrange(64)
            out.add(at)
    return sorted(out)


def test_edges_lose_no_link_whatever_the_buckets(spark):
    prints = _family(400, 5)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    least = brute_groups(prints)
    want = sorted((p, q) for p in prints for q in prints if p < q and least[p] == least[q])
    for blocks, bucket_rows in ((4, 8192), (4, 8), (6, 16)):
        edges = simhash.fingerprint_edges(frame, bucket_rows=bucket_rows, blocks=blocks)
        assert all(((a % 2**64) ^ (b % 2**64)).bit_count() <= 3 for a, b in plain(edges, "src", "dst"))
        root = {n % 2**64: r for n, r in plain(connected_components(edges), "node", "root")}
        groups = sorted((p, q) for p in prints for q in prints if p < q and p in root and root[p] == root.get(q))
        assert groups == want


def test_bucket_edges_span_each_group():
    prints = np.array(_family(200, 9), np.uint64)
    references = simhash.pivots(16)
    table_ = np.bitwise_count(prints[:, None] ^ references).astype(np.int8)
    edges = simhash.bucket_edges(prints, table_, 3)
    assert len(edges) < len(prints)
    root = list(range(len(prints)))
    for a, b in edges:
        root = [root[a] if r == root[b] else r for r in root]
    least = brute_groups([int(p) for p in prints])
    for a in range(len(prints)):
        for b in range(a):
            assert (root[a] == root[b]) == (least[int(prints[a])] == least[int(prints[b])])


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 5), (9, 8), (None, 4)], "src bigint, dst bigint")
    assert sorted(plain(connected_components(edges), "node", "root")) == [(1, 1), (2, 1), (5, 1), (8, 8), (9, 8)]
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert set(plain(connected_components(path), "root")) == {(0,)}
    assert connected_components(edges.limit(0)).count() == 0


def test_keeping_one(spark):
    docs = table(spark, ["a b c d e", "a b c d e", "other words stand here now", None, "", "A b c d e"], first_id=10)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(plain(kept, "doc_id"), key=str) == [(10,), (12,), (13,)]  # the copy without an id goes as well
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_keeping_one_row_where_ids_repeat(spark):
    """Rows are chosen, not ids: no text goes that is nobody's copy, and no copy stays beside another."""
    rows = [(1, "a b c d e", "x"), (1, "quite other words are in here", "x"), (2, "quite other words are in here", "y"), (3, "a b c d e", "x"), (None, "a b c d e", "x"), (None, "nobody copies this text at all", "x"), (None, "nobody copies this text at all", "x"), (4, "alike in all of its columns", "x"), (4, "alike in all of its columns", "x"), (4, "alike in all of its columns", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "map('k', source) AS m", "1 AS row", "2 AS key", "3 AS id", "4 AS _id", "5 AS th")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted(plain(kept, "doc_id", "text"), key=str)
    assert got == sorted([(1, "a b c d e"), (1, "quite other words are in here"), (4, "alike in all of its columns"), (None, "nobody copies this text at all")], key=str)


def test_hot_nodes_can_be_split(spark):
    """Both sides of each join come from a plain exchange of stored rows, which Spark can split where one node has most rows."""
    low = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.advisoryPartitionSizeInBytes": "10k"}
    for name, value in low.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        star = spark.range(1, 60_000).select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))
        both = checkpointed(star.union(star.select("dst", "src")).toDF("u", "v"))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")))
        plan = both.join(least, "u").select(F.sum("v"))
        plan.collect()
        assert "skew" in plan._jdf.queryExecution().executedPlan().toString()
        assert {r[0] for r in plain(connected_components(star), "root")} == {0}
    finally:
        for name in low:
            spark.conf.unset(f"spark.sql.{name}")
