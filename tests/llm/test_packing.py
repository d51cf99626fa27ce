from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from llm.cases import LONG, ODD
from tokenizers import Tokenizer

from earshot.llm import packing
from earshot.llm.bytepair import BytePairs


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "Hello  world\n\n it's", "a<|endoftext|>b <|endoftext|>", "é  ü\t\tx\x1cy\x85z", "　全角 ﬁ \U0001f600 ǆ ɐ ʰ",
         "don't  12 345 !!!...\r\n", LONG, "x" * 3000, " " * 500, "а б ٣٤ ½ Ⅷ _a_ ​‘’"]


def test_ids_equal_the_tokenizer(tokenizer):
    for text in TEXTS:
        assert BytePairs.shared().ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def check_places(got, capacity=2048):
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(make, tokenizer, odd_clashing, empty):
    got = packing.pack(odd_clashing).collect()
    want = Counter()
    for doc_id, text, *_ in ODD:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            want[doc_id, i, low, high - low, crc32(ids[low:high].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_places(got)
    assert packing.pack(empty).count() == 0


def test_packs_close_to_the_volume(make):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 2000, 400))] + [(1000 + i, "equal rows") for i in range(200)]
    got = packing.pack(make(rows)).collect()
    assert check_places(got) <= 1.04 * sum(r.length for r in got) / 2048


@pytest.mark.parametrize("lengths", [[7], [7] * 50, [100], [99, 2, 1] * 40, [51] * 30, [50] * 31, list(range(1, 101)), [60, 40, 30, 70, 33, 33, 34] * 9, []])
def test_plan_holds_exactly_the_counts(lengths):
    counts = np.bincount(lengths, minlength=101) if lengths else np.zeros(101, dtype=np.int64)
    plan = packing.round_down(counts, packing.configuration_lp(counts))
    held = Counter()
    for config, times in plan:
        assert sum(config) <= 100 and times > 0
        for length in config:
            held[length] += times
    assert held == Counter(lengths)
    sequences = sum(times for _, times in plan)
    best = 30 if lengths[:1] == [51] else -(-sum(lengths) // 100)
    assert sequences <= best + (2 if len(lengths) > 60 else 0)


def test_program_never_buys_more_than_there_is():
    counts = np.bincount(np.random.default_rng(2).integers(1, 129, 5000), minlength=129)
    bought = packing.configuration_lp(counts)
    covered = np.zeros(129)
    for config, amount in bought.items():
        assert sum(config) <= 128
        for length in config:
            covered[length] += amount
    assert (covered <= counts + 1e-6).all() and covered.sum() > 0.9 * counts.sum()
    assert sum(bought.values()) >= (covered * np.arange(129)).sum() / 128 - 1e-6


def test_few_lengths_without_an_exact_filling():
    counts = np.zeros(2049, dtype=np.int64)
    counts[[1032, 531, 521, 491]] = 6000, 6000, 6000, 12000
    plan = packing.round_down(counts, packing.configuration_lp(counts))
    assert sum(times for _, times in plan) <= 1.02 * 9000
