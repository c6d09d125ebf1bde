"""Byte-level BPE without merging: Aho-Corasick matches, backtracking, pair compatibility.

A token list is what BPE makes of its bytes if and only if BPE keeps each two neighbours
apart. So a piece is encoded by taking the longest token at each place and going back to
shorter ones until every token is compatible with the one before it. What stands before a
place is then fixed, so a place from which no token leads on is marked once and never
tried again: the work is linear in the length of the piece.
"""

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .arrow_text import held, text_udf
from .segments import CLOSE, CUTS, Memo

#: Pairs of neighbours remembered in a worker.
MEMO_PAIRS = 500_000
#: Pieces and words remembered in each of the two generations of a memo.
MEMO_PIECES, MEMO_WORDS = 100_000, 200_000
#: Marks that are a piece by themselves behind a word.
MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class Pairs(dict):
    """Remembered answers for pairs of tokens, left << 32 | right; starts anew when it is full."""

    def __init__(self, decide):
        super().__init__()
        self.decide = decide

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MEMO_PAIRS:
            self.clear()
        answer = self[pair] = self.decide(pair >> 32, pair & 0xFFFFFFFF)
        return answer


class Vocabulary:
    """Encoding and decoding of byte strings by merge ranks, where a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids, self.token = ranks, {r: t for t, r in ranks.items()}
        #: The two tokens whose merge makes a token; tokens that merging never makes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        made = {t: r for t, r in ranks.items() if len(t) == 1}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(last := self._merged(token, rank)) == 2:
                self.halves[rank] = (ranks[last[0]], ranks[last[1]])
                made[token] = rank
        #: The longest token that begins a token and is shorter.
        self.shorter: dict[int, int | None] = {}
        self.matches = ahocorasick.Automaton()
        for token, rank in made.items():
            self.shorter[rank] = next((made[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in made), None)
            self.matches.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matches.make_automaton()
        #: Tokens that lower ranks cannot make; trained vocabularies have none.
        self.unmade = ahocorasick.Automaton()
        for token in ranks.keys() - made.keys():
            self.unmade.add_word(token.decode("latin-1"), token)
        if len(self.unmade):
            self.unmade.make_automaton()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.pairs = Pairs(self.apart)

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """`token` after all merges of a rank under `below`."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these neighbours apart.

        Undoes the merges that made the two, latest first, and looks whether at any time the
        tokens then at the seam had merged earlier than the step being undone.
        """
        a, b, undone = left, right, len(self.ids) + 1
        while True:
            joint = self.ids.get(self.token[a] + self.token[b])
            # A merge of equal rank on the left of the seam comes first, on its right later.
            if joint is not None and joint < undone:
                return False
            split_a = a in self.halves and (a > b or b not in self.halves)
            if split_a:
                undone, a = a, self.halves[a][1]
            elif b in self.halves:
                undone, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern.

        Compatibility holds for tokens that lower ranks make; a piece in which another token
        occurs is merged step by step.
        """
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        spelled, size, apart, longest = piece.decode("latin-1"), self.size, self.pairs, self.matches.iter_long
        if len(self.unmade) and next(self.unmade.iter(spelled), None):
            return [self.ids[t] for t in self._merged(piece, max(self.token) + 1)]
        out: list[int] = []
        at, before = 0, None
        for _, (token, n) in longest(spelled):  # the longest matches, one after the other
            if before is not None and not apart[before << 32 | token]:
                break
            out.append(token)
            before, at = token, at + n
        else:
            return out
        closed: set[int] = set()
        token = self.shorter[token]
        while True:
            while token is not None and (at + size[token] in closed or out and not apart[out[-1] << 32 | token]):
                token = self.shorter[token]
            if token is None:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]
                continue
            out.append(token)
            at += size[token]
            if at == len(piece):
                return out
            token = next(longest(spelled, at))[1][0]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str):
    """(encode, decode) between a text and its ids in decimal, joined by spaces; one for each worker process."""
    vocabulary, pieces = Vocabulary(read_ranks(path)), regex.compile(pattern).findall

    def piece_ids(piece: str) -> str:
        return " ".join(map(str, vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))))

    piece_memo = Memo(piece_ids, MEMO_PIECES)

    def ids(text: str) -> str:
        return " ".join(map(piece_memo.__getitem__, pieces(text)))

    def word_ids(word: str) -> str:
        """Ids of a space and a word; plain words, and those with a mark behind, need no search for pieces."""
        if word.isalpha():
            return piece_ids(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return piece_memo[" " + word[:-1]] + " " + piece_memo[word[-1]]
        return ids(" " + word)

    # The safe cuts are those of the usual pattern; another pattern takes each text whole.
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    head, tail, feed = Memo(ids, MEMO_WORDS), Memo(word_ids, MEMO_WORDS), ids("\n")

    def encode(text: str) -> str:
        if pattern != usual:
            return ids(text)
        if CLOSE.search(text):
            return " ".join(map(head.__getitem__, filter(None, CUTS.split(text))))
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
            first, *rest = line.split(" ")
            if first:
                out.append(head[first])
            out += map(tail.__getitem__, rest)
        return " ".join(out)

    spelled = {str(i): t for i, t in vocabulary.token.items()}

    def decode(told: str) -> bytes:
        return b"".join(map(spelled.__getitem__, told.split()))

    return encode, decode


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row of `docs`; keep_ids adds `ids`, the decimal ids.

    ranks: path of a rank file that every worker has; pattern: cuts a text into the pieces
    that are encoded each by itself. decoded_sha256 is taken of the bytes that the ids
    stand for. Null or empty text: no tokens, and the digest of nothing. Null and repeated
    ids keep their rows; other columns are not read; an empty table gives an empty result.
    """

    def make():
        held(__name__, codec.cache_clear)
        encode, decode = codec(ranks, pattern)

        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                ids = encode(text)
                row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decode(ids)).hexdigest())
                rows.append((*row, ids) if keep_ids else row)
            return rows

        return work

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.string()} if keep_ids else {})
    coded = docs.select(F.col(id_col), text_udf(make, **fields)(F.col(text_col)).alias("c"))
    return coded.select(id_col, *(f"c.{name}" for name in fields))
