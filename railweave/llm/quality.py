"""Quality rules: counts over whole texts, and a linear-chain CRF over their lines."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrow_text import text_udf

SYMBOLS = b"#*$%&|<>"
#: Learning reads at most so many labelled documents. All their lines are cut into sequences
#: of so many lines, wherever they stand, and at most so many sequences are learned from.
SAMPLE_DOCS, SEQUENCE_LINES, SAMPLE_SEQUENCES = 2_000, 64, 6_000
#: Share of a text's words that must stand in content lines.
CONTENT_SHARE = 0.5
FEATURES = ("bias", "symbols", "exclamations", "capitals", "digits", "repeated words", "word after itself", "ends as a sentence", "few words", "log words", "word length", "earlier line again", "notice words")
#: Words of licence lines, page furniture and calls to act, in lower case.
NOTICE = frozenset("license licensed licence copyright rights reserved cookie cookies subscribe newsletter login logout register click menu navigation sitemap privacy terms share tweet advertisement sponsored".encode().split())
#: The fold of crc32(id) mod 5 that is never learned from, rounds of relabelling, and how far a line feature must go to be a cue of boilerplate before anything is learned.
HELD_OUT, ROUNDS, CUES = 0, 3, {"symbols": 0.15, "exclamations": 0.2, "capitals": 0.6, "repeated words": 0.6, "earlier line again": 0.5, "notice words": 0.4}


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of `window` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    suspects = order[np.r_[False, same] | np.r_[same, False]].tolist()
    seen = Counter(tuple(words[k : k + window]) for k in suspects)  # equal hashes are not yet equal words
    edge = np.zeros(len(words) + 1, np.int64)
    for k in suspects:
        if seen[tuple(words[k : k + window])] > 1:
            edge[k] += 1
            edge[k + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    # Code points are the bytes that do not continue a character.
    letters = b"".join(words)
    points = len(letters) - int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), points, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    """FEATURES of one line; again: whether an earlier line of the text has the same words."""
    size, n = len(line) or 1, len(words)
    upper, lower = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(line) - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return [
        1.0,
        min(1.0, 8 * (size - len(line.translate(None, SYMBOLS))) / size),
        min(1.0, 8 * line.count(b"!") / size),
        upper / (upper + lower) if upper + lower else 0.0,
        (size - len(line.translate(None, b"0123456789"))) / size,
        1 - len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(line.rstrip()[-1:] in b".!?"),
        float(n < 5),
        np.log1p(n) / 5,
        min(2.0, size / n / 10),
        float(again),
        min(1.0, 4 * sum(w.strip(b".,:;!?()") in NOTICE for w in line.lower().split()) / n),
    ]


def lines_of(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and word counts of the lines of `text` that have a word."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if words := line.split():
            rows.append(line_features(line, words, (key := b" ".join(words)) in seen))
            seen.add(key)
            sizes.append(len(words))
    return rows, sizes


class LineModel:
    """Linear-chain CRF with two labels, boilerplate 0 and content 1."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # features x 2; from x to

    @classmethod
    def plain(cls) -> "LineModel":
        """What an unlabelled corpus gets: every line is content."""
        emit = np.zeros((len(FEATURES), 2))
        emit[0, 1] = 1.0
        return cls(emit, np.zeros((2, 2)))

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, start: "LineModel | None" = None) -> "LineModel":
        """Gradient ascent (Adam) on the likelihood of the label sequences, by forward-backward over all at once; from the weights of `start` on."""
        if not sequences:
            return cls.plain()
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        longest, count = len(sequences[order[0]]), len(order)
        x, y = np.zeros((longest, count, len(FEATURES))), np.zeros((longest, count), np.int64)
        for at, k in enumerate(order):
            x[: len(sequences[k]), at], y[: len(labels[k]), at] = sequences[k], labels[k]
        lengths = np.array([len(sequences[k]) for k in order])
        live = [int((lengths > t).sum()) for t in range(longest)]  # the longer come first
        there = np.arange(longest)[:, None] < lengths
        one = np.eye(2)[y] * there[:, :, None]
        told_emit = np.einsum("tnf,tny->fy", x, one)
        told_move = np.einsum("tna,tnb->ab", one[:-1], one[1:])
        total = there.sum()
        weights = np.r_[start.emit, start.move] if start else np.zeros((len(FEATURES) + 2, 2))
        mean, spread = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, rounds + 1):
            emit, move = weights[:-2], np.exp(weights[-2:])
            score = np.exp(np.clip(x @ emit, -30, 30))
            forward, scale = np.zeros_like(score), np.ones((longest, count))
            for t in range(longest):
                n = live[t]
                now = score[t, :n] * (forward[t - 1, :n] @ move if t else 1.0)
                scale[t, :n] = now.sum(axis=1)
                forward[t, :n] = now / scale[t, :n, None]
            backward = np.ones_like(score)
            both = np.zeros((2, 2))
            for t in range(longest - 2, -1, -1):
                n = live[t + 1]
                after = score[t + 1, :n] * backward[t + 1, :n] / scale[t + 1, :n, None]
                both += (forward[t, :n].T @ after) * move
                backward[t, :n] = after @ move.T
            sure = forward * backward * there[:, :, None]
            slope = np.r_[told_emit - np.einsum("tnf,tny->fy", x, sure), told_move - both] / total - decay * weights
            mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
            weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        return cls(weights[:-2].copy(), weights[-2:].copy())

    def decode(self, rows: list[list[float]], lean: float = 0.0) -> list[int]:
        """Viterbi: the likeliest label sequence; at a tie content wins. lean: added to the score of every content line."""
        back = []
        (b0, b1), (s00, s01), (s10, s11) = (0.0, 0.0), *self.move.tolist()
        for k, (e0, e1) in enumerate((np.array(rows) @ self.emit + (0.0, lean)).tolist()):
            if k:
                from0, from1 = b1 + s10 >= b0 + s00, b1 + s11 >= b0 + s01
                back.append((from0, from1))
                b0, b1 = (b1 + s10 if from0 else b0 + s00), (b1 + s11 if from1 else b0 + s01)
            b0, b1 = b0 + e0, b1 + e1
        labels = [int(b1 >= b0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def content_share(self, text: str) -> float:
        """Share of the words of `text` that stand in content lines; 0 without words."""
        rows, sizes = lines_of(text)
        if not rows:
            return 0.0
        return sum(n for n, label in zip(sizes, self.decode(rows)) if label) / sum(sizes)


def cued(rows: np.ndarray) -> np.ndarray:
    """Which lines have a cue of boilerplate; in learning such lines are known to be that."""
    return np.logical_or.reduce([rows[:, FEATURES.index(name)] >= least for name, least in CUES.items()])


def seeded(rows: np.ndarray, label: int) -> np.ndarray:
    """First line labels: lines with a cue are boilerplate, others content; in a text labelled bad, all are boilerplate where no line has a cue."""
    cue = cued(rows)
    return np.zeros(len(rows), np.int64) if not label and not cue.any() else (~cue).astype(np.int64)


def relabelled(model: LineModel, parts: list[np.ndarray], sizes: list[np.ndarray], label: int, share: float) -> list[np.ndarray]:
    """The likeliest line labels of a document, with the least lean that makes their content share agree with its label.

    Cued lines stay boilerplate. Where that cannot agree, all lines get the document's label.
    """
    total = sum(int(n.sum()) for n in sizes)
    for lean in (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
        told = [np.where(cued(rows), 0, model.decode(rows, lean if label else -lean)) for rows in parts]
        content = sum(int(n[y == 1].sum()) for n, y in zip(sizes, told))
        if (content >= share * total) == bool(label):
            return told
    return [np.full(len(rows), label) for rows in parts]


def fit_latent(documents: list[tuple[int, list[np.ndarray], list[np.ndarray]]], share: float = CONTENT_SHARE, rounds: int = ROUNDS) -> LineModel:
    """Line model from documents (label, line features and word counts of their sequences) whose line labels are not known.

    Hard expectation maximisation: from seeded labels a model is fitted, its Viterbi labels
    under the document's label are the next ones, and so on. So a good document may have
    boilerplate lines and a bad one content, and moves between both are learned.
    """
    sequences = [rows for _, parts, _ in documents for rows in parts]
    labels = [seeded(rows, label) for label, parts, _ in documents for rows in parts]
    model = LineModel.fit(sequences, labels)
    for _ in range(rounds):
        now = [y for label, parts, sizes in documents for y in relabelled(model, parts, sizes, label, share)]
        if all(map(np.array_equal, labels, now)):
            break
        labels, model = now, LineModel.fit(sequences, now, rounds=50, start=model)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", sample: int = SAMPLE_DOCS) -> LineModel:
    """Line model from document labels: the labels of lines are latent, see `fit_latent`.

    Reads at most `sample` labelled documents (least hash of the id) whose crc32(id as text)
    mod 5 is not HELD_OUT, and of these whole documents, in that order, until they have
    SAMPLE_SEQUENCES line sequences; those bounds are for learning alone. Without both labels every line is content.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_chosen")).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = chosen.where(F.crc32(F.col("_chosen").cast("string").cast("binary")) % 5 != HELD_OUT).orderBy(F.xxhash64("_chosen"), "_chosen").limit(sample)
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text"))
    texts = own.join(F.broadcast(chosen), F.col("_own") == F.col("_chosen")).select(F.col("_chosen").cast("string").alias("id"), F.col("_label").alias("label"), "text")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, label, text in zip(*(batch[c].to_pylist() for c in ("id", "label", "text"))):
                rows, sizes = lines_of(text or "")
                cuts = range(0, len(rows), SEQUENCE_LINES)
                made = {"rows": pa.array([np.ravel(rows[at : at + SEQUENCE_LINES]) for at in cuts], pa.list_(pa.float64())), "sizes": pa.array([sizes[at : at + SEQUENCE_LINES] for at in cuts], pa.list_(pa.int64()))}
                yield pa.record_batch({"id": pa.array([doc] * len(cuts), pa.string()), "part": pa.array(range(len(cuts)), pa.int32()), "label": pa.array([label] * len(cuts), pa.int32()), **made})

    made = texts.mapInArrow(sequences, "id string, part int, label int, rows array<double>, sizes array<bigint>")
    got = made.orderBy(F.xxhash64("id"), "id", "part", "rows").limit(SAMPLE_SEQUENCES).toArrow()
    if got.num_rows == SAMPLE_SEQUENCES and got["id"][0] != got["id"][-1]:
        got = got.filter(pc.not_equal(got["id"], got["id"][-1]))  # the last document may be cut
    got = got.sort_by([("id", "ascending"), ("part", "ascending")])
    documents: dict[tuple[str, int], tuple[list, list]] = {}
    for doc, label, rows, sizes in zip(*(got[c].to_pylist() for c in ("id", "label", "rows", "sizes"))):
        parts, counts = documents.setdefault((doc, label), ([], []))
        parts.append(np.array(rows).reshape(-1, len(FEATURES)))
        counts.append(np.array(sizes))
    if len({label for _, label in documents}) < 2:
        return LineModel.plain()
    return fit_latent([(label, *lists) for (_, label), lists in documents.items()])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _verdict(model: LineModel, text_col: str, share: float):
    """struct of the counts, content_share, base_failed and kept of a text column."""

    def make():
        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                content = model.content_share(text)
                rows.append((*counts, content, failed, not failed and content >= share))
            return rows

        return work

    return text_udf(make, **dict.fromkeys(COUNTS, pa.int64()), content_share=pa.float64(), base_failed=pa.bool_(), kept=pa.bool_())(F.col(text_col))


def judged(docs: DataFrame, model: LineModel, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """(row, told): the rows of `docs` as structs, and the counts, content_share, base_failed and kept of each."""
    return docs.select(F.struct("*").alias("row"), _verdict(model, text_col, share).alias("told"))


def without_boilerplate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of `docs` that pass the base rules and stand mostly in content lines, all columns as they were."""
    return judged(docs, learn(docs, labels, id_col, text_col), text_col, share).where("told.kept").select("row.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) for each row.

    A text fails the base rules with under 10 words or over 20 % of its words in repeated
    5-word windows; of the others those stay whose words stand by at least CONTENT_SHARE in
    lines that the model takes for content. Null or empty text: no words, so it fails. Null
    and repeated ids keep their rows; other columns are not read; an empty table gives an
    empty result; without usable labels only the base rules decide.
    """
    told = judged(docs.select(F.col(id_col), F.col(text_col)), learn(docs, labels, id_col, text_col), text_col)
    return told.select(F.col("row")[id_col].alias(id_col), *(f"told.{c}" for c in (*COUNTS, "base_failed", "kept", "content_share")))
