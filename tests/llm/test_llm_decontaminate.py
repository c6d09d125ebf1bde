"""Benchmark passages against a search for every window."""

import hashlib
import random
import re

from helpers import ODD, by_id, plain, real, table

from railweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item, told in items:
        w = words(told)
        n = min(window, len(w))
        if not n:
            continue
        for gram in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) == gram:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} - {"None"}
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(own)


def cases(spark):
    random.seed(4)
    items = [(r[0], r[1]) for r in plain(real(spark, "benchmark"), "item_id", "text")][:20]
    items += [(900, "Two words"), (901, "two"), (902, None), (903, " .. "), (904, "a b a b a b a b a b a b a b a b"), (904, "b a"), (None, "never counts here")]
    texts = [r[0] for r in plain(real(spark), "text")][:80]
    for item, told in items[:20]:
        w = told.split()
        texts.append(" ".join([*"start of it".split(), *w[2:20], "end", *w[:5]]))
        texts.append(told.upper().replace(" ", " -- "))
    texts += ODD + ["zwei two words two", "never counts here", "x a b a b a b a b a b a b a b y", "a b " * 2000]
    return texts, items


def test_every_count_equals_the_search(spark, monkeypatch):
    texts, items = cases(spark)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = {k: brute(t, items) for k, t in enumerate(texts)}
    for block_words, piece_words in ((500_000, 20_000), (60, 20)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece_words)
        blocks = decontaminate.item_table(benchmark, 13, "item_id", "text")[1]
        assert blocks == 1 if block_words > 60 else blocks > 5
        got = by_id(decontaminate.contamination(table(spark, texts), benchmark), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert {k: got[k] for k in want} == want


def test_spans_are_cut_out(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(20))
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = table(spark, [f"Before, this. {item}! After it", "clean text", None, item + " x" * 500])
    got = decontaminate.remove_spans(docs, benchmark)
    assert got.columns == docs.columns  # also those with names that the operator could use itself
    texts = by_id(got, "text")
    assert texts[0] == ("Before, this. \n! After it",) and texts[1] == ("clean text",) and texts[2] == (None,) and texts[3][0].startswith(item)
    dropped = by_id(decontaminate.remove_spans(docs, benchmark, drop_coverage=0.0), "text")
    assert set(dropped) == {1, 2, 3, None}
    for limit, gone in ((0.04, True), (0.3, False)):  # 20 of 520 words are hit: 3.8 %
        shorter = by_id(decontaminate.remove_spans(table(spark, [item + " x" * 480]), benchmark, coverage=limit), "text")[0][0]
        assert shorter.startswith(item) != gone
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 5)
    assert by_id(decontaminate.remove_spans(docs, benchmark), "text") == texts


def test_limits_are_exact(spark):
    rows = spark.createDataFrame([(h, n) for h in range(0, 8) for n in range(1, 12)], "h bigint, n bigint")
    for share in (0, 0.05, 0.3, 0.4, 0.7, 1):
        got = rows.select("h", "n", decontaminate._over(rows.h, rows.n, share).alias("over")).collect()
        assert all(r["over"] == (r["h"] > 0 and r["h"] * 100 >= round(share * 100) * r["n"]) for r in got)


def test_long_repetitive_texts_take_linear_time():
    """Work a word does not grow with the text, also where it is one long match and short items end everywhere."""
    items = [("1", "a b " * 4000), ("2", "a"), ("3", "b a"), ("4", "c d e f g h i j k l m n o p")]
    automaton = decontaminate.ItemAutomaton(items)
    steps = []
    for n in (20_000, 200_000):
        words, climbs = [b"a", b"b"] * (n // 2), 0

        class Links(list):
            def __getitem__(self, k):
                nonlocal climbs
                climbs += 1
                return list.__getitem__(self, k)

        plain_links, automaton.link = automaton.link, Links(automaton.link)
        spans, found = automaton.match(words)
        automaton.link = plain_links
        steps.append(climbs / n)
        assert spans == [(0, n)] and found == {"1", "2", "3"}
    assert steps[1] < 1.1 * steps[0] < 40


def test_empty_tables(spark):
    docs, benchmark = table(spark, ["a b", None]), spark.createDataFrame([], "item_id bigint, text string")
    assert all(r[1:] == (0, 0, hashlib.sha256(b"").hexdigest(), False) for r in plain(decontaminate.contamination(docs, benchmark), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
