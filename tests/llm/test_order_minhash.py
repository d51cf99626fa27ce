import hashlib
import random
import re

import pytest
from llm.cases import ODD
from pyspark.sql import functions as F

from earshot.llm import order_minhash as omh

MASK = (1 << 30) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(value, seed=42, width=8):
    import xxhash

    data = value.encode() if isinstance(value, str) else (value & (1 << 64) - 1).to_bytes(8, "little") if width == 8 else (value & 0xFFFFFFFF).to_bytes(4, "little")
    return signed(xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1))


def chain(*values, last_width=8):
    seed = 42
    for i, v in enumerate(values):
        seed = xx(v, seed, last_width if i == len(values) - 1 else 8)
    return seed


def brute(text, k=3, size=2, sketches=64):
    words = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return [0] * sketches
    mers = [chain(*words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [chain(*words)]
    seen, ring = {}, []
    for i, m in enumerate(mers):
        n = seen.get(m >> 30, 0)
        seen[m >> 30] = n + 1
        ring.append((chain(m >> 30, n, last_width=4) & ~MASK) | i)
    ring.sort()
    out = []
    for b in range(sketches):
        start = next((j for j, g in enumerate(ring) if (g >> 58) + 32 >= b), 0)
        places = sorted(ring[(start + t) % len(ring)] & MASK for t in range(size))
        out.append(chain(*(mers[p] for p in places)) & 0xFFFF)
    return out


def texts(rng):
    words = "a b c d e f gh".split()
    return [None, "", " ", "a", "a b", "a b c", "a a a a a a a a a", *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)),
            " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(2000)), "x " * 5000]


def test_sketches_equal_brute_force(spark):
    rows = texts(random.Random(8))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").select("i", omh.sketches_of(F.col("text")).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    for i, text in enumerate(rows):
        assert got[i] == brute(text), (i, text and text[:50])


def test_order_counts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    moved = words[300:] + words[:300]
    edits = [list(words) for _ in range(3)]
    for n, e in zip((5, 40, 200), edits):
        for i in rng.sample(range(600), n):
            e[i] = "changed"
    sets = [" ".join(x) for x in (words, moved, *edits)]
    df = spark.createDataFrame([(sets[0], t) for t in sets], "a string, b string").select(
        omh.likeness(omh.sketches_of(F.col("a")), omh.sketches_of(F.col("b"))).alias("s"))
    same, rotated, few, some, many = (r.s for r in df.collect())
    assert same == 1 and same > few > some > many and 0.2 < rotated < 0.8


@pytest.mark.parametrize("block_docs", [1, 3, 500])
def test_next_document(make, monkeypatch, block_docs):
    monkeypatch.setattr(omh, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(omh, "_LEVEL", 4)
    rng = random.Random(block_docs)
    ids = rng.sample(range(-1000, 10**6), 40)
    rows = [(d, "".join(rng.choices("abcé \U0001f600", k=rng.randint(0, 30)))) for d in ids]
    docs = make(rows)
    bounds = omh.block_bounds(docs, block_docs)
    assert len(bounds) >= 30 if block_docs == 1 else len(bounds) >= 1
    got = {r.doc_id: r.next_text for r in omh.with_next(docs.select("doc_id", "text"), ["text"], bounds).collect()}
    ordered = sorted(rows)
    assert got == {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def test_report(make, odd_clashing, empty):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(10)))]
    got = {r.doc_id: r for r in omh.report(make(rows)).collect()}
    for i, (_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        mine, other, following = brute(text), brute(edited), brute(after)
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:04x}" for x in s) for s in (mine, other))
        assert r.near_edited == sum(a == b for a, b in zip(mine, other)) / 64
        assert r.near_next == sum(a == b for a, b in zip(mine, following)) / 64
    assert omh.report(odd_clashing).count() == len(ODD) and omh.report(empty).count() == 0
    alone = omh.report(make([(5, "one two three four")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 18
