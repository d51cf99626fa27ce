import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.cases import LONG, ODD
from tokenizers import Tokenizer
from zlib import crc32

from earshot.llm import token_counts, training_order


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_equal_the_tokenizer(processor):
    rng = random.Random(6)
    parts = ["a", "bc", "  ", " ", "\n", "\t", "é", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "\r", "　", "ﬁ", "\U0001f600", "word", "\x85"]
    counter = token_counts.PieceCounter.shared()
    assert not counter.whole
    texts = ["", " ", "\n", LONG, "x" * 2000] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(3000)]
    for table in ({}, {" a": 1, "\n": 1}):
        for text in texts:
            assert counter.count(text, table) == len(processor.encode(text)), repr(text)


def test_border_check():
    assert token_counts.crosses_borders(["▁▁a", "b", "▁", "<0x0A>", "\n"]) == []
    assert token_counts.crosses_borders(["a▁", "\na", "a\n"]) == ["a▁", "\na", "a\n"]


def test_table_and_rows(odd_clashing, empty, processor, monkeypatch):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd_clashing).collect()}
    assert got == {(d, len((t or "").encode()), n := len(processor.encode(t or "")), n > 4096) for d, t, *_ in ODD}
    assert token_counts.count_tokens(empty).count() == 0
    table = token_counts.frequent_lengths(odd_clashing, rows=50)
    assert len(table) == 50 and all(len(t) <= token_counts.LONGEST for t in table)


def test_caches_change_no_count(processor, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 3)
    counter = token_counts.PieceCounter("piece_bpe_32k.model")
    for text in ["a b c d e a b", "a b x y", "e d c b a a"]:
        assert counter.count(text, {}) == len(processor.encode(text))
    assert len(counter.cache) <= 6


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        orders = [training_order.Feistel(size, key)(np.arange(size)).tolist() for key in (0, 1)]
        assert all(sorted(o) == list(range(size)) for o in orders)
        assert size < 64 or orders[0] != orders[1]


def test_shards_hold_every_sequence_in_order(odd_clashing, empty, tmp_path):
    path = str(tmp_path / "shards")
    got = sorted(training_order.materialise(odd_clashing, path, key=9, sequence=64, shard_rows=100).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, i // 64, len(ids[i:i + 64]), tuple((ids[i:i + 64] + [0] * 64)[:64])) for i in range(0, len(ids), 64)]
    sizes = {}
    for r in got:
        assert r.byte_offset == 128 * sizes.get(r.shard, 0)
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(sizes) > 3
    for start in (0, 17, len(got) - 1):
        read = list(training_order.read_slots(path, start))
        assert [crc32(s.tobytes()) for s in read] == [r.ids_crc32 for r in got[start:]]
    read = [tuple(s.tolist()) for s in training_order.read_slots(path)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.n_tokens, s) for r, s in zip(got, read)), key=key) == sorted(want, key=key)
    assert training_order.materialise(empty, str(tmp_path / "none")).count() == 0
    assert list(training_order.read_slots(str(tmp_path / "none"))) == []
    # The order is that of the permuted indexes, from the definition.
    layout = training_order.Layout(odd_clashing, 9, 64, 100)
    permuted = training_order.Feistel(layout.size, 9)
    order = []
    for doc_id, text, *_ in ODD:
        n = -(-(len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1) // 64)
        first = layout.number(doc_id, text or "")
        order += [(int(permuted(np.array([first + i], dtype=np.uint64))[0]), doc_id is not None, doc_id or 0, i) for i in range(n)]
    assert [(r.doc_id, r.piece) for r in got] == [(d if told else None, i) for _, told, d, i in sorted(order)]


def test_ids_far_apart(make, tmp_path):
    rows = [(-(2**63), "first"), (2**63 - 1, "last"), (0, "middle"), (None, "no id")]
    got = training_order.materialise(make(rows), str(tmp_path)).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3] and {r.doc_id for r in got} == {r[0] for r in rows}


def test_no_shard_holds_a_hot_id(make, tmp_path):
    rows = [(None if i % 4 else i, f"text number {i} " * 3) for i in range(3000)] + [(7, f"another {i}") for i in range(1000)]
    got = training_order.materialise(make(rows), str(tmp_path), sequence=16, shard_rows=200).groupBy("shard").count().collect()
    assert len(got) > 15 and max(r["count"] for r in got) < 3 * sum(r["count"] for r in got) / len(got)


def test_a_second_attempt_settles(tmp_path):
    from pyarrow import fs

    class Refusing:
        """A store that does not rename over files."""

        def __init__(self):
            self.store = fs.LocalFileSystem()

        def move(self, a, b):
            if self.store.get_file_info(b).type != fs.FileType.NotFound:
                raise OSError("exists")
            self.store.move(a, b)

        def __getattr__(self, name):
            return getattr(self.store, name)

    for attempt in ("a", "b"):
        (tmp_path / attempt).write_bytes(b"same bytes")
        training_order._settle(Refusing(), str(tmp_path / attempt), str(tmp_path / "shard"), 10)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["shard"]
    (tmp_path / "c").write_bytes(b"others")
    with pytest.raises(OSError):
        training_order._settle(Refusing(), str(tmp_path / "c"), str(tmp_path / "shard"), 6)
