import itertools
import random
import re

import numpy as np
import xxhash
from llm.cases import LONG, ODD
from pyspark.sql import functions as F

from earshot.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """Smallest reachable member of each key, over links of fingerprints."""
    first = {k: k for k in prints}

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            low, high = sorted((root(a), root(b)))
            first[high] = low
    return {k: root(k) for k in prints}


def test_fingerprint_equals_the_definition():
    rng = random.Random(2)
    for text in [None, "", " \n", "A b", "a b c d", "É B c d e", *(" ".join(rng.choices("ab cD é".split(), k=30)) for _ in range(40))]:
        assert simhash.fingerprint(text) == fingerprint(text)
    assert simhash.fingerprint(LONG) == fingerprint(LONG)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).astype(np.int64)


def test_masks_cover_the_radius():
    for radius, places in ((1, 64), (2, 30), (4, 20)):
        masks = simhash.covering_masks(radius, places=places)
        assert len(masks) == 2 ** (radius + 1) - 1
        for differing in itertools.combinations(range(places), radius):
            assert any(not m & sum(1 << i for i in differing) for m in masks)


def test_links_connect_as_all_pairs_would(spark):
    rng = random.Random(7)
    prints = {0}
    for centre in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(60):  # chains and clouds around each centre
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3)))
            prints |= {centre, centre ^ (1 << rng.randrange(64)), centre ^ (31 << rng.randrange(59))}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    for limit in (2048, 3):  # 3: all larger buckets are divided by further masks
        found = simhash.links(table, limit=limit).collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
        joined = {p: p for p in signed}

        def root(k, joined=joined):
            while joined[k] != k:
                k = joined[k]
            return k

        for a, b in found:
            low, high = sorted((root(a), root(b)))
            joined[high] = low
        want = classes({p: p & (2**64 - 1) for p in signed})
        assert {p: root(p) for p in signed} == want


def test_near_copies_and_odd_rows(make, odd, odd_clashing, empty):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(i, " ".join(base[:50 + i] + ["changed"] + base[51 + i:])) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(30)] + [(200 + i, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(100))) for i in range(30)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.report(make(rows)).collect()}
    prints = {d: fingerprint(t) for d, t in rows}
    assert {d: p for d, (p, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == classes(prints)
    named = [r for r in ODD if r[0] is not None]
    want = classes({d: fingerprint(t) for d, t, *_ in named})
    assert {r.doc_id: r.component_id for r in simhash.report(odd).collect() if r.doc_id is not None} == want
    assert simhash.report(odd).count() == len(ODD) and simhash.report(empty).count() == 0
    kept = simhash.one_of_each(odd_clashing)
    assert kept.columns == odd_clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_exploded_buckets_are_never_broadcast(spark, monkeypatch):
    # 3,000 fingerprints are few bytes, their 93,000 buckets are not; Spark sizes both alike.
    plans = []
    monkeypatch.setattr(simhash, "via_table", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    prints = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    mask = F.explode(F.array(*(F.lit(m) for m in simhash.covering_masks()))).alias("mask")
    simhash._shared(prints.select("fp", mask).withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))))
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
