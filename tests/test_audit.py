"""Connector audit: components and ways by rail against plain searches, and the figures of a known audit."""

import heapq
import random

import pytest

from pyspark.sql import functions as F

from railweave.checkpoints import stored
from railweave.operators import audit

#: Metres of 34 connector chords of a known audit, of the way by rail (None: over the limit) and their ratio.
KNOWN = [
    (900, 911, 1.0), (889, 916, 1.0), (888, 892, 1.0), (884, 884, 1.0), (881, 1067, 1.2), (870, 1057, 1.2), (861, 880, 1.0), (860, 1093, 1.3), (856, 857, 1.0), (856, 861, 1.0),
    (849, 862, 1.0), (846, 848, 1.0), (836, 1071, 1.3), (783, None, None), (774, 774, 1.0), (762, None, None), (750, 769, 1.0), (686, 10008, 14.6), (673, 673, 1.0), (606, 606, 1.0),
    (518, 530, 1.0), (492, 507, 1.0), (485, 485, 1.0), (455, 475, 1.0), (449, 450, 1.0), (445, 452, 1.0), (444, 446, 1.0), (406, 406, 1.0), (373, 2753, 7.4), (371, 2081, 5.6),
    (343, 343, 1.0), (324, 324, 1.0), (181, 2516, 13.9), (151, 2188, 14.5),
]


def test_known_audit(spark):
    rows = spark.createDataFrame([(c, None if w is None else float(w), r) for c, w, r in KNOWN], "chord_m int, rail_m double, want double")
    told = rows.withColumn("ratio", audit.ratio(F.col("rail_m"), F.col("chord_m"))).withColumn("verdict", audit.verdict(F.lit(True), F.col("rail_m"), F.col("ratio")))
    got = told.collect()
    assert all(r["ratio"] == r["want"] for r in got)
    kinds = [r["verdict"] for r in got]
    assert (kinds.count("parallel"), kinds.count("shortcut"), kinds.count("none in limit")) == (27, 5, 2)


def brute_components(pairs):
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind):
    random.seed(1)
    if kind == "random":
        pairs = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    elif kind == "path":
        order = random.sample(range(1000), 300)
        pairs = list(zip(order, order[1:])) + [(5000, 5001)]
    elif kind == "star":
        pairs = [(7, k) for k in range(8, 600)] + [(599, 2)]
    else:
        pairs = [(1, 1), (3, 2), (3, 2), (2, 3), (9, 9)]
    rounds = []
    keep = lambda f: rounds.append(1) or stored(f)
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in audit.components(edges, keep).collect()}
    assert got == brute_components(pairs)
    assert len(rounds) <= 2 + 3 * 12  # rounds grow with the logarithm of the longest way


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert audit.components(none, stored).count() == 0
    assert audit.components(spark.createDataFrame([(None, 1), (2, None)], "src bigint, dst bigint"), stored).count() == 2


def network(seed, n=60, m=90):
    """Random stations within some kilometres, and edges both ways."""
    rng = random.Random(seed)
    at = {k: (135 + rng.random() * 0.2, 35 + rng.random() * 0.2) for k in range(n)}
    edges = []
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        length, link = rng.random() * 9000, rng.random() < 0.2
        for s, t in ((a, b), (b, a)):
            edges.append((s, t, length, "" if link else "L", "" if link else "O", "" if link else "1", link, *at[s], *at[t]))
    return at, edges


COLUMNS = "src bigint, dst bigint, length_m double, line string, operator string, institution string, is_connector boolean, src_lon double, src_lat double, dst_lon double, dst_lat double"


def shortest(edges, source):
    out, heap, to = {}, [(0.0, source)], {}
    for a, b, length, *_ in edges:
        to.setdefault(a, []).append((b, length))
    while heap:
        cost, k = heapq.heappop(heap)
        if k not in out:
            out[k] = cost
            for b, length in to.get(k, ()):
                heapq.heappush(heap, (cost + length, b))
    return out


def test_chords_against_plain_searches(spark):
    at, edges = network(3)
    rails = [e for e in edges if not e[6]]
    chords = [(a, b, 10.0 + a) for a in range(0, 30) for b in (a + 7, a + 20)] + [(7, 0, 3.0), (1000, 5, 4.0)]
    got = {(r["src"], r["dst"]): r for r in audit.chord_audit(spark.createDataFrame(chords, "src bigint, dst bigint, chord_m double"), spark.createDataFrame(rails, COLUMNS), stored, 9_000.0).collect()}
    parts = brute_components([e[:2] for e in rails])
    assert set(got) == {tuple(sorted(c[:2])) for c in chords} and got[0, 7]["chord_m"] == 3.0
    kinds = set()
    for (a, b), r in got.items():
        way = shortest(rails, a).get(b)
        assert r["connected"] == (a in parts and parts[a] == parts.get(b))
        assert (way is not None) == r["connected"]
        assert (r["rail_m"] is None) == (way is None or way > 9000) and (r["rail_m"] is None or abs(r["rail_m"] - way) < 1e-6)
        kinds.add(r["verdict"])
    assert kinds == {"apart", "none in limit", "shortcut", "parallel"} or kinds >= {"apart", "none in limit", "shortcut"}


def test_solving_with_and_without_connectors(spark):
    at, edges = network(5)
    rng = random.Random(2)
    asked = [(k, *rng.sample(range(60), 2)) for k in range(40)]
    sections = audit._plain(spark.createDataFrame([(k, a, b, *at[a], *at[b]) for k, a, b in asked], "section_id bigint, src bigint, dst bigint, from_lon double, from_lat double, to_lon double, to_lat double"))
    bare = spark.createDataFrame(edges, COLUMNS)
    got = {r["section_id"]: r for r in audit.without_connectors(sections, bare, stored).collect()}
    assert len(got) == 40
    # Detours are no ways: the plain searches leave them out by the same rule.
    from railweave.operators.solve import _detour

    seen = set()
    for k, a, b in asked:
        ways = [shortest(e, a).get(b) for e in (edges, [e for e in edges if not e[6]])]
        ways = [None if w is None or _detour(at[a], at[b], w) else w for w in ways]
        r = got[k]
        for w, name in zip(ways, ("with_m", "without_m")):
            assert (r[name] is None) == (w is None) and (w is None or abs(r[name] - w) < 1e-6)
        want = "unsolved" if ways[0] is None else "lost" if ways[1] is None else "same" if abs(ways[1] / ways[0] - 1) < 1e-9 else "other"
        assert r["outcome"] == want
        seen.add(want)
    assert len(seen) >= 3
    totals = audit.compared_totals(audit.without_connectors(sections, bare, stored)).first()
    both = [r for r in got.values() if r["with_m"] is not None and r["without_m"] is not None]
    assert totals["sections"] == 40 and totals["lost"] == sum(r["outcome"] == "lost" for r in got.values())
    assert abs(totals["change"] - (sum(r["without_m"] for r in both) / sum(r["with_m"] for r in both) - 1)) < 1e-9


def test_components_in_one_box_are_packed(spark, monkeypatch):
    """Each edge goes to one task, however many components share a box; large ones are cut, and all ways are those of brute force."""
    at, edges = network(3)
    rails = [e for e in edges if not e[6]]
    parts = brute_components([e[:2] for e in rails])
    ends = sorted(parts)
    chords = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in ends[:40] for b in ends if b > a and parts[a] == parts[b])]
    told = spark.createDataFrame(sorted(parts.items()), "node bigint, component bigint")
    held, solved = [], audit.solve.solve_wave

    def watched(rows, inside):
        held.append({r["region"]: r["count"] for r in inside.groupBy("region").count().collect()})
        return solved(rows, inside)

    monkeypatch.setattr(audit.solve, "solve_wave", watched)
    for pack in (10_000, 40, 1):
        found = audit.rail_ways(spark.createDataFrame(chords, "chord_id bigint, src bigint, dst bigint"), spark.createDataFrame(rails, COLUMNS).localCheckpoint(), 9_000.0, told, pack)
        got = {r["chord_id"]: r["rail_m"] for r in found.collect()}
        want = {k: shortest(rails, a)[b] for k, a, b in chords}
        assert set(got) == {k for k, m in want.items() if m <= 9_000.0} and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    whole = len([e for e in rails if parts[e[0]] in {parts[a] for _, a, _ in chords}])
    assert list(held[0].values()) == [whole] and all(k.startswith("pack") for k in held[0])
    assert any(";" in k for k in held[2])
