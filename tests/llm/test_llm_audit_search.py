"""Filter audit and ranked search against plain Python over whole tables, and against SQL."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import DATA, ODD, plain, real, table

from railweave.llm import filter_audit, lexical, queries

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    con, sf = duckdb.connect(), f"{DATA}/sf0.001"
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and sorted(plain(queries.QUERIES[name](spark, sf), *names), key=str) == sorted(rows, key=str)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def audited(rows, labels):
    """The audit of (id, part, text) rows, by the definition."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = Counter()
    shapley = Counter()
    for doc, part, text in rows:
        text, words, part = text or "", words_of(text), part or ""
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows),
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, order, step)
                out[key, "rows"] += 1
                if fails[x] and gone:
                    out[key, "redundant"] += 1
                if fails[x] and sum(fails.values()) == 1:
                    out[key, "unique_fails"] += 1
                if fails[x] and not gone:
                    gone = True
                    out[key, "removed"] += 1
                    shapley[part, x] += 1
                    out[key, "good_lost"] += doc in good
                    out[key, "toxic_lost"] += doc in toxic
                out[key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *(out[key, n] for n in names), shapley[key[0], key[1][key[2] - 1]]) for key, kind in list(out) if kind == "rows")


def test_audit_of_odd_rows(spark):
    random.seed(4)
    texts = ODD + ["same"] * 40 + [" ".join(random.choices(["a", "B", "c#", "Dd", "é"], k=n)) for n in (199, 200, 201, 400)] + ["A" * 2 + "b" * 98, "A" * 3 + "b" * 97]
    docs = table(spark, texts).selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'x' END AS source", "1 AS step", "2 AS part", "'q' AS digest", "true AS good")
    docs = docs.unionByName(docs.where("doc_id = 7"))
    labels = [(1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    flags = filter_audit.with_labels(filter_audit.document_flags(docs), spark.createDataFrame(labels, LABELS))
    got = filter_audit.filter_audit(flags)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(plain(got, *got.columns)) == audited(plain(docs, "doc_id", "source", "text"), labels)


def test_audit_without_rows_or_labels(spark):
    docs, labels = table(spark, ["a"]), spark.createDataFrame([], LABELS)
    flags = filter_audit.document_flags(docs)
    assert filter_audit.filter_audit(filter_audit.with_labels(flags, labels)).count() == 600
    assert filter_audit.filter_audit(filter_audit.with_labels(flags.limit(0), labels)).count() == 0


def test_other_filters(spark):
    """Orders and counts follow from the names: two filters have two orders."""
    flags = spark.createDataFrame([("p", True, False, True, True), ("p", False, False, False, True)], "part string, good boolean, toxic boolean, X boolean, Y boolean")
    got = sorted(plain(filter_audit.filter_audit(flags, "XY"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "shapley"))
    assert got == [("XY", 1, 1, 1, 0, 0, 1, 1), ("XY", 2, 0, 1, 1, 1, 0, 3), ("YX", 1, 0, 2, 0, 1, 1, 3), ("YX", 2, 0, 0, 1, 0, 0, 1)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def searched(docs, items, k=20):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if known else None, -score) for rank, (score, known, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_of_odd_rows(spark, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 40)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 4)
    vocabulary = ["a", "B", "é", "É", "漢字", "x1", "the", "of", "rare"]
    texts = ODD + [" ".join(random.choices(vocabulary, [9, 5, 3, 3, 1, 1, 30, 20, 0.2], k=random.randrange(30))) for _ in range(200)] + ["a-b_c a.b"] * 30
    docs = table(spark, texts)
    asked = [(1, "the rare of"), (2, None), (3, ""), (4, "A a a b"), (None, "é É 漢字"), (4, "zzz"), (5, "the"), (5, "the"), (6, " ".join(vocabulary * 3))]
    items = spark.createDataFrame([(*a, "x", 1) for a in asked], "item_id bigint, text string, score string, rank int")
    want = searched(plain(docs, "doc_id", "text"), asked)
    for block in (200_000, 3):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        got = lexical.ranked_search(docs, items)
        assert sorted(plain(got, "item_id", "rank", "doc_id", "score"), key=str) == want
    assert lexical.ranked_search(docs, items, k=3).where("item_id = 1").count() == 3


def test_search_of_nothing(spark):
    docs, items = table(spark, ["a"]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 99"), items.limit(0))):
        assert lexical.ranked_search(d, i).collect() == []


def test_long_texts_and_text_ids(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "word"), (3, "other")], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "word")], "item_id string, text string")
    got = plain(lexical.ranked_search(docs, items), "item_id", "rank", "doc_id", "score")
    assert got == searched([(r[0], r[1]) for r in docs.collect()], [("q", "word")])


@pytest.mark.parametrize("seed", range(30))
def test_shards_equal_scoring_everything(seed, monkeypatch):
    """Also where most terms are set aside and scores are often equal."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 1 + seed % 7)
    rng = np.random.default_rng(seed)
    n, v = 400, 12
    held = rng.random((n, v)) < rng.random(v) ** 2
    tfs = np.where(held, rng.integers(1, 2 + seed % 3 * 200, (n, v)), 0)
    lengths = 75 + rng.integers(0, 3 if seed % 2 else 400, n)
    docs, words = np.nonzero(tfs)
    shuffled = rng.permutation(len(docs))
    shard = lexical.Shard(lengths, docs[shuffled], words[shuffled], tfs[docs, words][shuffled])
    for k in (1, 5, 20, 1000):
        factors = {int(w): int(rng.integers(0, 9000)) for w in rng.choice(v + 3, 6, replace=False)}
        scores = sum(f * (10**9 * tfs[:, w] // np.maximum(1000 * tfs[:, w] + 12 * lengths, 1)) for w, f in factors.items() if w < v)
        want = sorted(((int(s), d) for d, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert shard.search(factors, k) == want
