"""Toxicity, language and quality: exact parts against brute force, models by held-out accuracy."""

import itertools
import random
import re
from collections import Counter

import numpy as np
from helpers import ODD, by_id, plain, real, table
from pyspark.sql import functions as F

from railweave.llm import langid, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_toxicity_of_held_out_documents(spark):
    docs, labels = real(spark, sf="sf0.1").select("doc_id", "text"), real(spark, "labels", "sf0.1")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank, bad = got.score.rank(), got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.93
    assert got.predicted[~bad].mean() < 0.02 and got.predicted[bad].mean() > 0.75
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_with_few_labels(spark):
    """51 labelled toxic documents are all there is to learn from at this size."""
    docs, labels = real(spark, sf="sf0.01").select("doc_id", "text"), real(spark, "labels", "sf0.01")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank, bad = got.score.rank(), got.toxic == 1
    assert (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.85
    assert got.predicted[~bad].mean() < 0.05


def test_toxicity_of_odd_tables(spark):
    docs = table(spark, ODD)
    none = spark.createDataFrame([], LABELS)
    got = plain(toxicity.toxicity_scores(docs, none), "doc_id", "held_out", "score", "predicted")
    assert len(got) == docs.count() and all(r[2:] == (0.0, 0) for r in got)
    texts = [f"you idiot number {k}" if k % 3 == 0 else f"a fine day number {k}" for k in range(90)]
    own = table(spark, texts + ODD, first_id=0)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)] + [(0, 1, None), (None, 1, 1), (3, 1, 0)], LABELS)
    got = by_id(toxicity.toxicity_scores(own, labels), "predicted")
    assert all(got[k] == (int(k % 3 == 0),) for k in range(90)) and got[91] == (0,)
    kept = toxicity.without_toxic(own, labels)
    assert kept.columns == own.columns and kept.where("text like 'you idiot%'").count() == 0
    assert kept.count() == 60 + len(ODD) + 1
    assert toxicity.toxicity_scores(own.limit(0), labels).count() == 0


def test_toxicity_features():
    lexicon = {b"idiot": 3.0, b"scum*": 2.0, b"scum": 4.0}
    got = toxicity.features("You IDIOT scummy w0rd!", lexicon)
    assert got[0] == 1 / 4 and got[2] == 1 / 4 and got[4] == 3.0 and got[7] == 1.0
    assert len(toxicity.features("", lexicon)) == len(got) and toxicity.features("", lexicon)[0] == 0


def test_language_of_held_out_documents(spark):
    docs = real(spark, sf="sf0.1")
    got = langid.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_scores_equal_counting():
    random.seed(3)
    weights = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3))
    texts = ["".join(random.choice("abcé 漢") for _ in range(n)) for n in (0, 1, 2, 50, 70_000)]
    for text, row in zip(texts, langid.log_scores(texts, weights)):
        assert np.allclose(row, langid.gram_counts(text) @ weights)
        assert langid.gram_counts(text).sum() == sum(max(0, len(text) - n + 1) for n in langid.GRAMS)


def test_long_texts_are_counted_whole(monkeypatch):
    text = "the quick brown fox " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 64)
    assert (langid.gram_counts(text) == whole).all()


def test_language_of_odd_texts(spark):
    docs = table(spark, [None, "", "123 !!", "der die das und", "x"], first_id=1)
    got = plain(langid.language_ids(docs), "lang_pred", "score")
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert set(plain(langid.language_ids(unknown), "lang_pred")) == {("und",)}
    assert langid.language_ids(docs.limit(0)).count() == 0


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_base_counts_equal_counting(spark):
    random.seed(6)
    texts = [r[0] for r in plain(real(spark), "text")] + ODD + ["".join(random.choice("ab \n\t#é\xa0\x1c| ") for _ in range(80)) for _ in range(200)]
    got = by_id(quality.quality_verdicts(table(spark, texts), spark.createDataFrame([], LABELS)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for k, text in enumerate(texts):
        want = base(text)
        assert got[k] == (*want, not want[-1]), text  # without labels the base rules decide alone


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    for _ in range(60):
        model = quality.LineModel(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
        rows = rng.normal(size=(rng.integers(1, 8), len(quality.FEATURES)))

        def score(labels):
            return sum(rows[k] @ model.emit[:, y] for k, y in enumerate(labels)) + sum(model.move[a, b] for a, b in itertools.pairwise(labels))

        best = max(map(score, itertools.product((0, 1), repeat=len(rows))))
        assert np.isclose(score(model.decode(rows.tolist())), best)


def test_learning_raises_the_likelihood():
    rng = np.random.default_rng(4)
    labels = [np.cumsum(rng.random(n) < 0.3) % 2 for n in (3, 8, 8, 1, 12)]
    rows = [np.c_[np.ones(len(y)), y + rng.normal(size=len(y)) * 0.3, np.zeros((len(y), len(quality.FEATURES) - 2))] for y in labels]

    def likelihood(model):
        total = 0.0
        for r, y in zip(rows, labels):
            score = lambda z: sum(r[k] @ model.emit[:, v] for k, v in enumerate(z)) + sum(model.move[a, b] for a, b in itertools.pairwise(z))
            total += score(y) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=len(y))])
        return total

    fitted = quality.LineModel.fit(rows, labels)
    assert likelihood(fitted) > likelihood(quality.LineModel.plain()) + 5
    assert np.mean(np.concatenate([fitted.decode(r.tolist()) for r in rows]) == np.concatenate(labels)) > 0.9


def test_quality_of_labelled_documents(spark):
    docs, labels = real(spark, sf="sf0.01"), real(spark, "labels", "sf0.01")
    got = quality.quality_verdicts(docs, labels).join(labels, "doc_id")
    kept = {r[0]: r[1] for r in plain(got.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))), "*")}
    assert kept[1] > 0.98 and kept[0] < 0.15
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0


def test_quality_of_held_out_documents(spark):
    """Documents of the fold that is never learned from; and many have lines of both kinds."""
    docs, labels = real(spark, sf="sf0.1"), real(spark, "labels", "sf0.1")
    got = quality.quality_verdicts(docs, labels).cache()
    held = got.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == quality.HELD_OUT)
    kept = {r[0]: r[1] for r in plain(held.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))), "*")}
    assert kept[1] > 0.98 and kept[0] < 0.1
    assert got.where("content_share > 0 AND content_share < 1").count() > 300
    got.unpersist()


PROSE = ["the river ran slowly past the old mill and the fields beyond it.", "nobody had opened the gate since the end of the long winter.", "she counted the boats twice before she wrote the number down."]
NOTICES = ["Released under the MIT License.", "All rights reserved. Privacy terms cookies", "WIN!! BIG!! NOW!! CLICK!! HERE!! FAST!!"]


def mixed(k):
    """A text of content with boilerplate at its end, and the number of words of each."""
    content = [f"{k} {line}" for line in PROSE]
    return "\n".join([*content, *NOTICES]), sum(len(x.split()) for x in content), sum(len(x.split()) for x in NOTICES)


def test_lines_of_one_text_get_both_labels(spark):
    """Content lines of mixed texts stay content, though labels are of whole documents."""
    good = [mixed(k)[0] if k % 2 else "\n".join(f"{k} {x}" for x in PROSE) for k in range(60)]
    bad = ["\n".join(f"BUY!! {k}!! NOW!! {n}!! CHEAP!! GOODS!!" for n in range(5)) for k in range(60)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], LABELS)
    model = quality.learn(docs, labels, "doc_id", "text")
    text, content, notices = mixed(1)
    rows, sizes = quality.lines_of(text)
    assert model.decode(rows) == [1, 1, 1, 0, 0, 0]
    share = by_id(quality.quality_verdicts(docs, labels), "content_share", "kept")
    assert share[1] == (content / (content + notices), True) and share[0] == (1.0, True) and share[60][0] == 0.0
    kept = quality.without_boilerplate(docs, labels)
    assert kept.columns == docs.columns and set(by_id(kept, "text")) == set(range(60))


def test_line_labels_agree_with_their_document():
    rng = np.random.default_rng(7)
    model = quality.LineModel(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for label in (0, 1):
        for _ in range(30):
            parts = [np.c_[rng.normal(size=(n, len(quality.FEATURES) - 2)) * 0.05, np.zeros((n, 2))] for n in (3, 5)]
            sizes = [rng.integers(1, 9, size=len(p)) for p in parts]
            told = np.concatenate(quality.relabelled(model, parts, sizes, label, 0.5))
            assert (np.concatenate(sizes)[told == 1].sum() >= 0.5 * np.concatenate(sizes).sum()) == bool(label)
