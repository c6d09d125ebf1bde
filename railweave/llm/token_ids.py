"""Token ids of whole texts by the tokenizers library, each distinct word of a batch encoded once."""

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_counts import balanced

#: Texts of a batch, in bytes about: the more, the fewer words are encoded twice.
BATCH_BYTES = 4 << 20
#: White space next to white space, as Unicode and the C0 separators have it; there the look-ahead for a last space matters.
CLOSE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Pieces remembered in a worker, and bytes of them.
KNOWN_PIECES, KNOWN_BYTES = 500_000, 32 << 20
#: Pieces in one text given to the library.
PIECES_A_TEXT = 4096
#: A line feed or nothing, letters of ASCII and Latin-1, a mark or nothing: letters with or without a space before
#: them are one piece of the usual byte-level pattern, and a mark at the end is another.
PIECES = r"^(?P<feed>\n?)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,;:!?]?)$"


class Ragged:
    """Lists of ids, one after the other: `ids`, and `ends`, where each list ends."""

    def __init__(self, lists: Iterable[list[int]] = (), ids: np.ndarray | None = None, ends: np.ndarray | None = None):
        if ids is None:
            lists = list(lists)
            ends, ids = np.cumsum([len(x) for x in lists], dtype=np.int64), np.array([i for x in lists for i in x], np.uint32)
        self.ids, self.ends, self.sizes = ids, ends, np.diff(ends, prepend=0)

    def take(self, places: np.ndarray) -> "Ragged":
        """The lists at `places`, in that order."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return Ragged(ids=self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[places] - ends, sizes)], ends=ends)

    def grouped(self, counts: np.ndarray) -> "Ragged":
        """Consecutive lists joined, so many each."""
        return Ragged(ids=self.ids, ends=np.append(0, self.ends)[np.cumsum(counts)])

    @staticmethod
    def chain(*some: "Ragged") -> "Ragged":
        before = np.cumsum([0, *(len(x.ids) for x in some)])
        return Ragged(ids=np.concatenate([x.ids for x in some]), ends=np.concatenate([x.ends + n for x, n in zip(some, before)]))


class Known:
    """Ids of pieces seen before, as arrays: a piece that comes again in a later batch is looked up, not encoded."""

    def __init__(self, measure: Callable[[pa.Array], Ragged]):
        self.measure, self.pieces, self.ids = measure, pa.array([], pa.string()), Ragged()

    def of(self, pieces: pa.Array) -> Ragged:
        """The ids of distinct pieces. Those of this batch stay known, and those of earlier ones, within KNOWN_PIECES and KNOWN_BYTES."""
        at = pc.index_in(pieces, self.pieces)
        fresh = pieces.filter(at.is_null())
        made = self.measure(fresh)
        table = Ragged.chain(self.ids, made)
        places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = len(self.pieces) + np.arange(len(fresh))
        found = table.take(places)
        for kept, ids in ((pa.concat_arrays([self.pieces, fresh]), table), (pieces, found), (pieces[:0], Ragged())):
            if len(kept) <= KNOWN_PIECES and kept.nbytes <= KNOWN_BYTES:
                self.pieces, self.ids = kept, ids
                break
        return found


def _batches(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about BATCH_BYTES; a longer text is one by itself."""
    reached, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Callable[[pa.Array], Ragged], int]:
    """(function from an array of texts without nulls to their ids, size of the vocabulary) by the tokenizer file at `path`; one for each worker process.

    No added special tokens, no truncation or padding; strings of special tokens inside
    texts are special tokens, the library's default. For byte-level files whose pattern is
    the usual one, texts are cut where it always has a boundary, and distinct words encoded
    once a batch; texts without such boundaries, and all texts of other files, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    def loaded() -> Tokenizer:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return made

    whole = loaded()

    def singly(texts: Iterable[str]) -> Ragged:
        return Ragged(x.ids for batch in balanced(texts) for x in whole.encode_batch_fast(batch, add_special_tokens=False))

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    split, size = told.get("pre_tokenizer") or {}, whole.get_vocab_size()
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer") and not told.get("post_processor")
    # A special token may hold no white space, else a cut could fall into it; nor may plain words hold one.
    if not usual or any(re.search(r"\s", x["content"]) or x["content"][:1].isalpha() or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
        return lambda texts: Ragged.chain(Ragged(), *(singly(batch.to_pylist()) for batch in _batches(texts))), size

    # The same model over strings that are one piece each: cut at line feeds, without the pattern.
    plain = loaded()
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    spelled = np.zeros(size, np.int64)
    for token, i in told["model"]["vocab"].items():
        spelled[i] = len(token)

    def of_pieces(pieces: pa.Array) -> Ragged:
        texts = ["\n".join(pieces.slice(at, PIECES_A_TEXT).to_pylist()) for at in range(0, len(pieces), PIECES_A_TEXT)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in plain.encode_batch_fast(texts, add_special_tokens=False))])
        # A token spells as many bytes as it has characters, so a piece ends where the spelled bytes reach its own.
        reached = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        return Ragged(ids=ids, ends=np.searchsorted(np.cumsum(spelled[ids]), reached) + 1)

    known, known_others = Known(of_pieces), Known(lambda words: singly(words.to_pylist()))
    ends = Ragged([[], *(whole.encode(m, add_special_tokens=False).ids for m in ["\n", *".,;:!?"])])
    mark_at, feed = pa.array(["", "\n", *".,;:!?"]), ends.sizes[1]

    def of_words(words: pa.Array) -> Ragged:
        """Ids of words without spaces: of a line feed and the word, where one begins it, else of a space and the word."""
        cut = pc.extract_regex(words, PIECES)
        simple = np.flatnonzero(cut.is_valid())
        line, letters, mark = cut.take(pa.array(simple)).flatten()
        pieces = pc.binary_join_element_wise(pc.if_else(pc.equal(line, ""), " ", ""), letters, "").dictionary_encode()
        stems = known.of(pieces.dictionary)
        at_feed, at_mark = (pc.index_in(x, mark_at).to_numpy(zero_copy_only=False) for x in (line, mark))
        odd = np.flatnonzero(~np.asarray(cut.is_valid()))
        others = known_others.of(pa.array([w[1:] if w[:1] == "\n" else " " + w for w in words.take(pa.array(odd)).to_pylist()], pa.string()))
        # The parts of every word, of one table: what ends words, stems, all others.
        table, parts = Ragged.chain(ends, stems, others), np.zeros((len(words), 3), np.int64)
        parts[simple] = np.stack([at_feed, len(ends.ends) + pieces.indices.to_numpy(zero_copy_only=False), at_mark], axis=1)
        parts[odd, 1] = len(ends.ends) + len(stems.ends) + np.arange(len(odd))
        parts[odd, 0] = np.asarray(pc.starts_with(words, "\n"))[odd]
        return table.take(parts.ravel()).grouped(np.full(len(words), 3))

    def of_plain_texts(texts: pa.Array) -> Ragged:
        # Line feeds go with the word behind; one more stands at the start of each text and is taken off again.
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1
        firsts = np.cumsum(counts + 1) - counts - 1  # what stands before the added feed is no word
        words = lists.flatten().filter(pa.array(~np.isin(np.arange(counts.sum() + len(counts)), firsts))).dictionary_encode()
        told = of_words(words.dictionary).take(words.indices.to_numpy(zero_copy_only=False)).grouped(counts)
        keep = np.ones(len(told.ids), bool)
        keep[((told.ends - told.sizes)[:, None] + np.arange(feed)).ravel()] = False
        return Ragged(ids=told.ids[keep], ends=told.ends - feed * np.arange(1, len(texts) + 1))

    def encode(texts: pa.Array) -> Ragged:
        found = [Ragged()]
        for batch in _batches(texts):
            close = pc.match_substring_regex(batch, CLOSE_SPACE).to_numpy(zero_copy_only=False)
            both = Ragged.chain(of_plain_texts(batch.filter(pa.array(~close))), singly(batch.filter(pa.array(close)).to_pylist()))
            found.append(both.take(np.argsort(np.argsort(close, kind="stable"))))
        return Ragged.chain(*found)

    return encode, size
