import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from llm.cases import LONG, ODD, row

from earshot.llm import periodic_runs as pr


def brute_lyndon(word):
    """Longest Lyndon word at each place: the next smaller suffix ends it."""
    n = len(word)
    return [next((j - i for j in range(i + 1, n) if word[j:] < word[i:]), n - i) for i in range(n)]


def brute_runs(word, min_words=24, repeats=3):
    """Longest stretches of period q, for every q, without those of a smaller period."""
    n, found = len(word), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, repeats * q):
                found.setdefault((i, j + q - i), q)  # a smaller period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(), len(words), len(dropped))


def periodic(rng, n, letters):
    """Letters at random with periodic stretches, some of them inside each other."""
    out = []
    while len(out) < n:
        unit = [rng.randint(0, letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 4)
        stretch = unit * rng.randint(1, 6)
        out += stretch[:rng.randint(1, len(stretch))] + [rng.randint(0, letters) for _ in range(rng.randint(0, 4))]
    return out[:n]


def test_grouping_yields_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.randint(0, 4)
        word = periodic(rng, rng.randint(1, 50), letters)
        assert pr.lyndon_lengths(word, letters + 1) == brute_lyndon(word)
    assert pr.lyndon_lengths([0] * 5000, 1) == [1] * 5000
    assert pr.lyndon_lengths(list(range(3000)), 3000) == list(range(3000, 0, -1))


@pytest.mark.parametrize("min_words, repeats", [(24, 3), (2, 2), (6, 2), (1, 3), (9, 4)])
def test_runs_equal_brute_force(min_words, repeats):
    rng = random.Random(min_words * 10 + repeats)
    some = 0
    for _ in range(700):
        word = periodic(rng, rng.randint(0, 120), rng.randint(0, 5))
        got = pr.find_runs(np.array(word, dtype=np.int64), min_words, repeats)
        assert sorted(got) == brute_runs(word, min_words, repeats)
        some += bool(got)
    assert some > 300


def test_every_anchor_of_a_run_occurs_again():
    for min_words, repeats in [(24, 3), (10, 2), (5, 4), (40, 3)]:
        k = pr.anchor_length(min_words, repeats)
        for q in range(1, 60):
            n = max(min_words, repeats * q)
            word = list(range(q)) * (n // q + 1)
            word = word[:n]
            spots = [tuple(word[i:i + k]) for i in range(n - k + 1)]
            assert all(spots.count(s) > 1 for s in spots), (min_words, repeats, q)
    assert pr.anchor_length(24, 3) == 8


def test_ties_of_the_strongest_run():
    assert pr.strongest([(5, 30, 10), (0, 24, 8), (9, 27, 9)]) == (0, 24, 8)
    assert pr.strongest([(0, 24, 8), (50, 25, 8)]) == (50, 25, 8)
    assert pr.strongest([(3, 30, 10), (3, 27, 9)]) == (3, 27, 9)


def test_report_equals_brute_force(make, odd_clashing, empty):
    rng = random.Random(4)
    rows = []
    for i in range(250):
        words = [f"w{x}" for x in periodic(rng, rng.randint(0, 200), rng.randint(0, 6))] if i % 3 else [f"u{rng.randint(0, 60)}" for _ in range(90)]
        rows.append(row(i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [row(1 << 60, "a " * 40), row(None, "b c " * 30), row(None, "b c " * 30), row(30, "x " * 24), row(30, "x " * 23)]
    got = [tuple(r) for r in pr.report(make(rows)).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r[:2]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60
    names = ("doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256 n_words n_dropped").split()
    odd = pr.report(odd_clashing)
    assert odd.columns == names
    short = [r for r in ODD if r[1] != LONG]
    assert sorted((tuple(r) for r in odd.collect() if r.doc_id != 8), key=repr) == sorted((brute(*r[:2]) for r in short), key=repr)
    assert pr.report(empty).count() == 0


def test_long_texts(make):
    rows = [row(1, LONG), row(3, "again " * 200_000), row(4, " ".join(f"u{i}" for i in range(150_000)) + " end of it" * 1000)]
    got = {r.doc_id: r for r in pr.report(make(rows), damage=None).collect()}
    assert (got[1].start, got[1].length, got[1].period) == (0, 30_000, 997) and got[1].n_runs == 1
    assert (got[3].start, got[3].length, got[3].period, got[3].exponent_milli) == (0, 200_000, 1, 200_000_000)
    assert (got[4].start, got[4].length, got[4].period) == (150_000, 3000, 3)


def test_collapsed_texts(make, odd_clashing):
    rows = [row(1, "to be or not " * 8 + "that is"), row(2, "a  b\nc"), row(3, None), row(4, "la " * 30)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pr.collapse(make(rows)).collect()}
    assert got == {1: ("to be or not that is", 20), 2: ("a  b\nc", 6), 3: (None, None), 4: ("la", 2)}
    assert pr.collapse(odd_clashing).columns == odd_clashing.columns and pr.collapse(odd_clashing).count() == len(ODD)
