"""Trained operators against plain second versions of them, and every operator on very long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from helpers import by_id, plain, real, table

from railweave.llm import chat, filter_audit, langid, quality, sharding, simhash, toxicity

LONG = 250_000
LABELS = "doc_id bigint, quality int, toxic int"


def grams(text):
    """Buckets of the 1- to 3-grams of a text, by the stated hash, number by number."""
    mask, points, out = 2**32 - 1, [ord(c) for c in text.lower()], Counter()
    for at in range(len(points)):
        key = 0
        for n, point in enumerate(points[at : at + 3], 1):
            key = (key * 0x9E3779B1 & mask) ^ ((point + n) * 0x85EBCA77 & mask)
            out[((key ^ key >> 15) * 0xC2B2AE3D & mask) >> 18] += 1
    return out


def test_language_ids_equal_a_plain_naive_bayes(spark):
    docs = real(spark)
    rows = plain(docs, "doc_id", "text", "lang")
    counts, seen = {}, Counter()
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(str(doc).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(text or ""))
            seen[lang] += 1
    langs = sorted(counts)
    sums = {lang: sum(counts[lang].values()) + 0.5 * 2**14 for lang in langs}
    got = by_id(langid.language_ids(docs), "lang_pred", "score")
    for doc, text, _ in rows:
        own = grams(text or "")
        scores = {lang: math.log((seen[lang] + 1) / (seen.total() + len(langs))) + sum(n * math.log((counts[lang][b] + 0.5) / sums[lang]) for b, n in own.items()) for lang in langs}
        best = max(langs, key=lambda lang: (scores[lang], -langs.index(lang)))
        share = 1 / sum(math.exp(s - scores[best]) for s in scores.values())
        if re.search(r"[^\W\d_]", text or ""):
            assert got[doc][0] == best and abs(got[doc][1] - share) < 1e-6
        else:
            assert got[doc] == ("und", 0.0)


def test_kept_equals_the_best_of_all_labelings(spark):
    """For texts of up to twelve lines: all labelings are scored; words of content lines decide with the base rules."""
    docs, labels = real(spark), real(spark, "labels")
    model = quality.learn(docs, labels, "doc_id", "text")
    got = by_id(quality.quality_verdicts(docs, labels), "base_failed", "kept", "content_share")
    tried = 0
    for doc, text in plain(docs, "doc_id", "text"):
        rows, sizes = quality.lines_of(text or "")
        if not 0 < len(rows) <= 12:
            continue
        tried += 1
        emit = np.array(rows) @ model.emit
        marks = (np.arange(2 ** len(rows))[:, None] >> np.arange(len(rows))) & 1
        score = emit[np.arange(len(rows)), marks].sum(axis=1) + model.move[marks[:, :-1], marks[:, 1:]].sum(axis=1)
        best = np.isclose(score, score.max(), rtol=0, atol=1e-9)
        shares = {round(float((np.array(sizes) * m).sum() / sum(sizes)), 12) for m in marks[best]}
        failed, kept, share = got[doc]
        assert round(share, 12) in shares and kept == (not failed and share >= quality.CONTENT_SHARE)
    assert tried > 30


def test_toxicity_scores_follow_from_features_and_trees(spark):
    """The score of a text is the calibrated mean of both halves' trees over its own features, walked by hand."""
    docs, labels = real(spark, sf="sf0.01").select("doc_id", "text"), real(spark, "labels", "sf0.01")
    scorer = toxicity.learn(docs, labels, "doc_id", "text")

    def walked(node, x):
        while node.numDescendants() > 0:
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    def raw(model, x):
        return sum(w * walked(t._call_java("rootNode"), x) for t, w in zip(model.trees, model.treeWeights))

    some = [(d, t) for d, t in plain(docs, "doc_id", "text")][:40]
    got = by_id(toxicity.toxicity_scores(docs, labels), "score", "predicted")
    assert len(scorer.trees) == 2
    likely = {d: sum(1 / (1 + math.exp(-2 * raw(m, toxicity.features(t or "", scorer.lexicon)))) for m in scorer.trees) / 2 for d, t in some}
    # Calibration only rises, so scores lie in the order of what the trees say.
    order = sorted(some, key=lambda r: likely[r[0]])
    scores = [got[d][0] for d, _ in order]
    assert all(a <= b + 1e-9 for a, b in zip(scores, scores[1:])) and all(got[d][1] == (got[d][0] >= 0.5) for d, _ in some)


def long_docs(spark):
    """A text of 250,000 different words, one of as many equal ones and one without spaces, among short ones."""
    texts = [" ".join(f"w{k * 7919 % 1_000_003}" for k in range(LONG)), "Same\n" * LONG, "x" * LONG, "short one", None]
    return texts, table(spark, texts)


def test_long_texts(spark):
    texts, docs = long_docs(spark)
    prints = by_id(simhash.simhash_components(docs), "fingerprint")
    words = re.findall(r"[^\x20\x09-\x0D]+", texts[0])
    bits = np.zeros(64)
    for k in range(len(words) - 2):
        bits += np.unpackbits(np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42)], ">u8").view(np.uint8))
    assert prints[0][0] == "".join(f"{b:02x}" for b in np.packbits(bits * 2 > len(words) - 2))
    assert prints[1][0] == f"{xxhash.xxh64_intdigest('same same same', 42):016x}" and len(prints) == 6

    none = spark.createDataFrame([], LABELS)
    scores = by_id(toxicity.toxicity_scores(docs, none), "score")
    assert len(scores) == 6 and all(0 <= s[0] <= 1 for s in scores.values())

    told = by_id(quality.quality_verdicts(docs, none), "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed")
    assert told[0] == (LONG, sum(map(len, words)), 0, 0, False) and told[1] == (LONG, 4 * LONG, LONG - 1, LONG, True) and told[2] == (1, LONG, 0, 0, True)

    placed = by_id(sharding.shard_rows(docs), "size", "text_crc32")
    assert all(placed[k] == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in enumerate(texts[:4]))

    flags = {r["id"]: (r["A"], r["B"], r["C"], r["D"], r["E"]) for r in filter_audit.document_flags(docs).collect() if r["id"] is not None}
    assert flags[0] == (False,) * 5 and flags[1] == (False, True, True, False, False) and flags[2] == (True, False, False, False, False)


def test_long_conversations(spark):
    said = ["<|im_end|> é" * 100_000, "word " * LONG]
    turns = spark.createDataFrame([(1, 0, "user", said[0]), (1, 1, "assistant", said[1])], "conv_id bigint, turn bigint, role string, text string")
    got = chat.chat_digests(chat.format_chats(turns)).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(said[1]), sha(said[1]))
    assert got["turns_sha256"] == sha(f"user\n{said[0]}\nassistant\n{said[1]}\n")
