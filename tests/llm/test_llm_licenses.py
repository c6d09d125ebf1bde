"""License scans: planted notices, and alignments against the longest common subsequence."""

import random

from helpers import ODD, by_id, table
from hypothesis import given, settings, strategies as st

from railweave.llm import licenses


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignments_are_common_subsequences(text, template):
    pairs = licenses.patience(text, template)
    assert all(text[a] == template[b] for a, b in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= common(text, template)
    if len(set(template)) == len(template) and len(set(text)) == len(text):  # all words are anchors
        assert len(pairs) == common(text, template)


@given(st.lists(st.integers(0, 30), unique=True))
def test_longest_increasing_run(places):
    got = licenses.increasing(list(enumerate(places)))
    assert all(p[1] < q[1] for p, q in zip(got, got[1:]))
    best = [1] * len(places)
    for k in range(len(places)):
        best[k] = 1 + max((best[j] for j in range(k) if places[j] < places[k]), default=0)
    assert len(got) == max(best, default=0)


def test_planted_notices_are_found(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    filler = " ".join(f"word{k}" for k in range(3000))
    edited = " ".join("changed" if k % 12 == 5 else w for k, w in enumerate(gpl.split()))
    texts = [f"{filler} {mit} {filler}", mit.upper(), f"{filler}\n{edited}\n{filler}", f"{mit} {filler} {mit} {gpl}", filler, " ".join(mit.split()[: len(mit.split()) // 2]), *ODD]
    got = by_id(licenses.license_scan(table(spark, texts)), "license", "coverage", "n_aligned", "first_word", "last_word", "n_licenses", "licenses")
    assert got[0][:2] == ("MIT", 1.0) and got[0][3] == 3000
    assert got[1][:2] == ("MIT", 1.0)
    assert got[2][0] == "GPL-3.0" and 0.8 <= got[2][1] < 1
    assert "MIT" in got[3][6].split(",") and "GPL-3.0" in got[3][6].split(",")
    assert got[4] == (None, 0.0, 0, None, None, 0, "")
    assert got[5][0] != "MIT"
    assert all(got[k][0] is None for k in range(6, 6 + len(ODD)))
    assert licenses.license_scan(table(spark, ["x"]).limit(0)).count() == 0


def test_own_templates(spark):
    docs = table(spark, ["alpha beta gamma delta", "alpha gamma"])
    got = by_id(licenses.license_scan(docs, {"own": "alpha beta gamma delta"}, coverage=0.5), "license", "coverage")
    assert got[0] == ("own", 1.0) and got[1] == ("own", 0.5)


def slow(text, coverage=licenses.COVERAGE):
    """Names of the templates that some stretch of the text covers, all starts and two lengths tried."""
    words, names = licenses.words_of(text), set()
    for name, told in licenses.TEMPLATES.items():
        t = licenses.Template(name, told)
        n = len(t.words)
        if any(t.fit(words[s : s + size], coverage) for size in (n, 3 * n // 2) for s in range(max(1, len(words) - n // 2))):
            names.add(name)
    return names


def test_find_equals_trying_every_stretch():
    """Copies with words left out, words of other templates around them. One licence a text: between copies of kin the line is not sharp."""
    random.seed(3)
    given = tuple(sorted(licenses.TEMPLATES.items()))
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    noise = lambda: [random.choice(vocabulary) if random.random() < 0.7 else f"w{random.randrange(99)}" for _ in range(random.randint(0, 12))]
    for k in range(100):
        copy = [w for w in random.choice(list(licenses.TEMPLATES.values())).split() if random.random() > 0.04 * (k % 6)]
        text = " ".join([*noise(), *(copy * random.choice((1, 1, 2, 3))), *noise()])
        fast, want = {f[0] for f in licenses.find(text, given)}, slow(text)
        hidden = {part for part, whole in licenses.PART_OF.items() if whole in want}
        assert want - hidden <= fast | hidden and fast <= want | hidden, (sorted(want ^ fast), text)


def test_work_grows_with_the_text(monkeypatch):
    """Words aligned for one notice and ever more telling words around it: in proportion, not with the square."""
    aligned = []
    patience = licenses.patience
    monkeypatch.setattr(licenses, "patience", lambda text, template: aligned.append(len(text)) or patience(text, template))
    given = tuple(sorted(licenses.TEMPLATES.items()))
    random.seed(1)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)} - licenses.COMMON)
    sums = []
    for n in (4_000, 16_000):
        aligned.clear()
        text = [*(random.choice(vocabulary) for _ in range(n)), licenses.TEMPLATES["MIT"]]
        assert "MIT" in {f[0] for f in licenses.find(" ".join(text), given)}
        sums.append(sum(aligned))
    assert sums[1] < 6 * sums[0]
    aligned.clear()
    many = licenses.find(f"{licenses.TEMPLATES['MIT']} " * 300, given)
    assert sum(f[0] == "MIT" for f in many) == 300 and sum(aligned) < 300 * 200 * len(licenses.words_of(licenses.TEMPLATES["MIT"]))
