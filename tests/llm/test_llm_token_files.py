"""Packed token files against the library and against a plain reading of the whole corpus."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD, plain, real, table
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from railweave.llm import token_files, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def wanted(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.data())
def test_packing_is_undone(bits, n, data):
    ids = np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    first = data.draw(st.integers(0, n))
    assert (token_files.unpack(packed, bits, first, n - first) == ids[first:]).all()


def test_long_lists_are_packed_in_steps(monkeypatch):
    monkeypatch.setattr(token_files, "STEP_IDS", 64)
    ids = np.arange(1000, dtype=np.uint32) * 7 % 2**13
    packed = token_files.pack(ids, 13)
    assert (token_files.unpack(packed, 13, 5, 990) == ids[5:995]).all() and len(packed) == 1625


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts(texts):
    encode, _ = token_ids.encoder(PATH)
    got = encode(pa.array(texts, pa.string()))
    assert [got.ids[e - n : e].tolist() for e, n in zip(got.ends, got.sizes)] == wanted(texts)


def test_words_marks_feeds_and_special_strings():
    random.seed(3)
    bits = ["the", "Été", "x1", ".", ",", " ", " ", "\n", "\t", "<|endoftext|>", "漢字", "'s", "don't", "a\x1cb", "\x85", "?!", "  ", "ß"]
    texts = ["".join(random.choices(bits, k=random.randrange(12))) for _ in range(3000)] + [t or "" for t in ODD] + ["a" * 70_000, "word " * 40_000]
    encode, _ = token_ids.encoder(PATH)
    got = encode(pa.array(texts, pa.string()))
    for text, e, n, ids in zip(texts, got.ends, got.sizes, wanted(texts)):
        assert got.ids[e - n : e].tolist() == ids, text[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    encode, _ = token_ids.encoder(public_tokenizers.path(name))
    got = encode(pa.array(["Hello world", "", "a  b\n c<|endoftext|>"]))
    assert got.ids.tolist() == [i for t in ["Hello world", "", "a  b\n c<|endoftext|>"] for i in library.encode(t, add_special_tokens=False).ids]


def test_files_hold_the_corpus(spark, tmp_path, monkeypatch):
    texts = [r[0] for r in plain(real(spark), "text")] + ODD
    docs = table(spark, texts, first_id=50).repartition(5)
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH)
    rows = sorted(plain(docs, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0))
    corpus, want = [], []
    for (doc, _), ids in zip(rows, wanted(t for _, t in rows)):
        ids = [*ids, 0]
        want.append((doc, len(corpus), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        corpus += ids
    got = token_files.read_documents(spark, path, keep_ids=True)
    assert sorted(plain(got, "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want
    assert [i for ids, in sorted((plain(got.orderBy("start"), "ids")), key=lambda r: 0) for i in ids] == corpus
    for first, n in [(0, 10), (0, len(corpus)), (len(corpus) // 2, 5000), (len(corpus) - 3, 10), (len(corpus), 4), (7, 0)]:
        assert token_files.read_ids(spark, path, first, n).tolist() == corpus[first : first + n]
    bits = {r[0] for r in plain(spark.read.parquet(f"{path}/blocks"), "bits")}
    assert bits == {16}


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (3, "x y"), (3, "x"), (3, "x"), (1, None)], "doc_id bigint, text string")
    token_files.write_token_files(docs, str(tmp_path / "some"), PATH)
    got = sorted(plain(token_files.read_documents(spark, str(tmp_path / "some")), "start", "doc_id", "n_tokens"))
    assert got == [(0, None, 2), (2, None, 2), (4, 1, 1), (5, 3, 2), (7, 3, 2), (9, 3, 3)]
    token_files.write_token_files(docs.limit(0), str(tmp_path / "none"), PATH)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0
    assert token_files.read_ids(spark, str(tmp_path / "none"), 0, 5).tolist() == []


def test_blocks_are_of_whole_documents(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 10)
    ends = np.array([4, 8, 30, 31, 41])
    rows = list(token_files.blocks_of(2, 100, list("abcde"), np.arange(41, dtype=np.uint32), ends, 9))
    assert [(r["doc_ids"], r["first"], r["n_ids"], r["ends"]) for r in rows] == [(["a", "b"], 100, 8, [4, 8]), (["c"], 108, 22, [22]), (["d"], 130, 1, [1]), (["e"], 131, 10, [10])]
    assert [i for r in rows for i in token_files.unpack(r["packed"], 9, 0, r["n_ids"])] == list(range(41))


def test_what_is_known_is_bounded(monkeypatch):
    asked = []
    known = token_ids.Known(lambda pieces: asked.extend(pieces.to_pylist()) or token_ids.Ragged([[len(x)] * len(x) for x in pieces.to_pylist()]))
    told = lambda some: [x.tolist() for x in np.split(got.ids, got.ends[:-1])] if (got := known.of(pa.array(some, pa.string()))) else None
    assert told(["a", "bb"]) == [[1], [2, 2]] and told(["ccc", "a"]) == [[3, 3, 3], [1]] and asked == ["a", "bb", "ccc"]
    monkeypatch.setattr(token_ids, "KNOWN_PIECES", 4)
    assert told(["d", "a", "eeee"]) == [[1], [1], [4, 4, 4, 4]] and known.pieces.to_pylist() == ["d", "a", "eeee"]
    monkeypatch.setattr(token_ids, "KNOWN_BYTES", 30)
    assert told(["x" * 40, "a"]) == [[40] * 40, [1]] and known.pieces.to_pylist() == []
    assert told(["a"]) == [[1]]
