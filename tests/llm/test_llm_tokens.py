"""Token counts and byte-level BPE against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from helpers import ODD, by_id, plain, real, table
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from railweave.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts_of(spark):
    random.seed(2)
    mixed = ["".join(random.choice("abc dé\n \t'sll0199zzzß漢字🙂   \x1c\x85.,") for _ in range(random.randrange(60))) for _ in range(300)]
    special = ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", "x<|endoftext|>  y", "<|endoftext|>\n<|endoftext|>"]
    return [r[0] for r in plain(real(spark), "text")][:120] + ODD + mixed + special + ["a" * 70_000, "ab " * 50_000, " " * 500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path, texts = public_tokenizers.path(name), texts_of(spark)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        lengths = [len(model.encode(t or "")) for t in texts]
    else:
        tokenizer = Tokenizer.from_file(path)
        lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = by_id(token_counts.token_counts(table(spark, texts), path), "n_bytes", "n_tokens", "over_limit")
    for k, (text, n) in enumerate(zip(texts, lengths)):
        assert got[k] == (len((text or "").encode()), n, n > 512), text[:80]


def test_batches_are_balanced_by_bytes():
    batches = list(token_counts.balanced(["a" * 40, "é" * 30, "b" * 200, "c", "d"], 100))
    assert [len(b) for b in batches] == [2, 1, 2]
    assert list(token_counts.balanced([])) == []


def test_round_trip_equals_the_library(spark):
    texts = texts_of(spark)
    got = by_id(bpe.bpe_round_trip(table(spark, texts), RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for k, text in enumerate(texts):
        ids = ENCODING.encode_ordinary(text or "")
        assert got[k] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    encode, decode = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = encode(text)
    assert ids == " ".join(map(str, ENCODING.encode_ordinary(text)))
    assert decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=2, max_size=4), st.integers(), max_size=12), st.text("ab", max_size=14))
def test_any_vocabulary_equals_plain_merging(extra, text):
    """Also where some tokens cannot be made by merging."""
    tokens = [b"a", b"b", *(t.encode() for t in sorted(extra, key=lambda t: (extra[t], t)))]
    ranks = {t: k for k, t in enumerate(tokens)}
    vocabulary = bpe.Vocabulary(ranks)
    merged = vocabulary._merged(text.encode(), len(ranks))
    if text and text.encode() not in ranks:
        assert vocabulary.encode_piece(text.encode()) == [ranks[t] for t in merged]


def test_ids_are_kept_on_demand(spark):
    got = bpe.bpe_round_trip(table(spark, ["hello world"]), RANKS, public_tokenizers.PATTERN, keep_ids=True)
    assert plain(got, "ids")[0][0] == " ".join(map(str, ENCODING.encode_ordinary("hello world")))


def test_empty_tables(spark):
    none = table(spark, ["x"]).limit(0)
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.bpe_round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_are_not_kept():
    """A worker remembers short words only, within bounds of number and size."""
    known = token_counts.Known(lambda new: [len(x) for x in new])
    for k in range(50):
        long = known.learn({"x" * (100 + k), f"w{k}", "y"})
        assert known.young["x" * (100 + k)] == 100 + k and known.young["y"] == 1
        known.forget(long)
    assert set(known.young) == {"y", *(f"w{k}" for k in range(50))} and known.held == sum(map(len, known.young))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 100)
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 300)
    known = token_counts.Known(lambda new: [len(x) for x in new])
    for k in range(200):
        words = {f"{k}-{n}" for n in range(30)} | {"common"}
        known.forget(known.learn(words))
        assert words <= set(known.young) and all(known.young[w] == len(w) for w in words)
        assert len(known.young) <= 100 and sum(map(len, known.young)) == known.held <= 300


def test_a_worker_holds_one_operators_caches():
    from railweave.llm import arrow_text

    cleared = []
    arrow_text.held("one", lambda: cleared.append("one"))
    arrow_text.held("one")
    assert not cleared
    arrow_text.held("two")
    assert cleared == ["one"]
    arrow_text.held("three", lambda: cleared.append("three"))
    arrow_text.held("one", lambda: cleared.append("one"))
    assert cleared == ["one", "three"]
    arrow_text._CLEAR.clear()
