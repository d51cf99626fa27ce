"""Training order on disk: token sequences in keyed random order, in shards of fixed stride.

A document's token ids, with an end token, are cut into sequences of ``SEQUENCE``
ids, the last filled up with end tokens. A sequence's index is its document's (a hash of id and text, so rows
with null or repeated ids lie apart like any others) times the most sequences a document can have, plus
its number there. It goes through a keyed Feistel network over the smallest
even number of bits that holds all indexes; values beyond the domain walk on
through the network until they fall inside. That permutation is the order of training. It
needs no count of the sequences beforehand, so texts are tokenised once and
tokens are shuffled once: equal ranges of the permuted domain are the shards,
each sorted by its own task and streamed to one file. A sequence's slot is
its shard's first slot plus its row there, so slots run from 0 without gaps.

Every record has the same number of bytes: the ids as unsigned 16-bit numbers,
lowest byte first. Slot s is found by one seek, so a reader resumes anywhere from the folder alone (``read_slots``):
``manifest.json`` names the stride and the number of sequences, and the shards' sizes say how many each holds.
A shard is written under a name of its attempt and then renamed, so a lost executor leaves no half shard; a second
attempt writes the same bytes, and where a store refuses to rename over the first one's file, that file stays.

Null and empty texts are one sequence that holds the end token. Rows of equal id and text share
indexes; such ties stand side by side, ordered by number and content, and so do the few whose hashes agree. Very long
texts are tokenised whole; their ids are held in memory once. An empty table gives no rows and no shard, but a
manifest. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import sys
import uuid
from array import array
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.bytepair import BytePairs
from earshot.llm.common import per_row
from earshot.session import fresh_path, via_table

SEQUENCE = 256
END_ID = 0  # also fills up the last sequence, so records end in zero bytes
SHARD_ROWS = 65_536
# Small corpora are still written by this many tasks, as long as a shard has some rows.
MIN_SHARDS, LEAST_ROWS = 64, 1024
ROUNDS = 6
MANIFEST = "manifest.json"
# Ids whose documents are numbered in one call.
_HELD_IDS = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SEQUENCES = "doc_id long, piece int, shard int, place long, n_tokens int, ids binary"
_INDEX = "shard int, row long, doc_id long, piece int, n_tokens int, ids_crc32 long"


class Feistel:
    """A keyed permutation of ``range(size)``."""

    def __init__(self, size: int, key: int, rounds: int = ROUNDS) -> None:
        self.size = max(size, 1)
        self.half = np.uint64(max(1, -(-(self.size - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(crc32(f"{key}/{r}/a".encode()) << 32 | crc32(f"{key}/{r}/b".encode())) for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        with np.errstate(over="ignore"):
            for key in self.keys:
                mixed = (right + key) * np.uint64(_MIX[0])
                mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(_MIX[1])
                mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(_MIX[2])
                left, right = right, left ^ (mixed >> np.uint64(20) & self.mask)
        return left << self.half | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(index, dtype=np.uint64))
        outside = np.flatnonzero(out >= self.size)
        while len(outside):  # walk along the cycle until it is back inside
            out[outside] = self._once(out[outside])
            outside = outside[out[outside] >= self.size]
        return out


class Layout:
    """How documents and their sequences are numbered, permuted and dealt to shards."""

    def __init__(self, docs: DataFrame, key: int, sequence: int, shard_rows: int) -> None:
        n, total, longest = docs.agg(F.count("*"), F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
        self.sequence, self.key = sequence, key
        # A token has at least one byte, so this is a bound on the sequences of a document.
        self.pieces = ((longest or 0) + 1) // sequence + 1
        self.documents = (1 << 62) // self.pieces
        guess = (total or 0) // (3 * sequence) + (n or 0)
        self.shards = max(1, -(-guess // shard_rows), min(MIN_SHARDS, -(-guess // LEAST_ROWS)))
        self.size = self.documents * self.pieces

    def number(self, doc_id: int | None, text: str) -> int:
        """Where a document's sequences begin in the domain."""
        seed = crc32(str(doc_id).encode())
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) % self.documents * self.pieces

    def shard(self, place: np.ndarray) -> np.ndarray:
        width = -(-self.size // self.shards)
        return (place // np.uint64(width)).astype(np.int32)


def sequences(docs: DataFrame, layout: Layout) -> DataFrame:
    """Every sequence with its place in the permuted domain and its shard."""
    n = layout.sequence

    def dealt(held: list[tuple], permuted: Feistel) -> Iterator[tuple]:
        """Sequences of some documents; their places come from one call."""
        counts = np.array([-(-n_ids // n) for *_, n_ids in held])
        first = np.array([first for _, first, _, _ in held], dtype=np.uint64)
        piece = np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
        place = permuted(np.repeat(first, counts) + piece.astype(np.uint64))
        where = zip(piece.tolist(), layout.shard(place).tolist(), place.astype(np.int64).tolist())
        for doc_id, _, data, n_ids in held:
            for start in range(0, n_ids, n):
                i, shard, at = next(where)
                yield doc_id, i, shard, at, min(n, n_ids - start), data[2 * start:2 * (start + n)].ljust(2 * n, b"\0")

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        encoder, permuted = BytePairs.shared(), Feistel(layout.size, layout.key)
        held: list[tuple] = []
        size = 0
        for doc_id, text in texts:
            ids = [*encoder.ids(text or ""), END_ID]
            held.append((doc_id, layout.number(doc_id, text or ""), _two_bytes(ids), len(ids)))
            size += len(ids)
            if size >= _HELD_IDS:
                yield from dealt(held, permuted)
                held, size = [], 0
        if held:
            yield from dealt(held, permuted)

    return per_row(docs.select("doc_id", "text"), _SEQUENCES, rows)


def _two_bytes(ids: list[int]) -> bytes:
    """The ids as unsigned 16-bit numbers, lowest byte first."""
    packed = array("H", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def write_shards(rows: DataFrame, layout: Layout, path: str) -> DataFrame:
    """Write the sequences' shards below ``path``; one index row per sequence, in the order of the files."""
    dealt = rows.repartition(layout.shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "piece", "ids")

    def write(source: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for shard, mine in groupby(source, key=lambda r: r[0]):
            attempt = f"{folder}/_{shard_name(shard)}.{uuid.uuid4().hex}"
            row = 0
            with store.open_output_stream(attempt) as stream:
                for _, doc_id, piece, n_tokens, ids in mine:
                    stream.write(ids)
                    yield shard, row, doc_id, piece, n_tokens, crc32(ids)
                    row += 1
            _settle(store, attempt, f"{folder}/{shard_name(shard)}", row * 2 * layout.sequence)

    return per_row(dealt.select("shard", "doc_id", "piece", "n_tokens", "ids"), _INDEX, write)


def _settle(store, attempt: str, path: str, size: int) -> None:
    """Give a written file its name, unless an earlier attempt has left the same one there."""
    try:
        store.move(attempt, path)
    except OSError:
        if store.get_file_info(path).size != size:
            raise
        store.delete_file(attempt)


def materialise(docs: DataFrame, path: str, key: int = 0, sequence: int = SEQUENCE,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write all shards below ``path``. One row per sequence: its document, number, slot, shard and byte offset."""
    from pyarrow import fs

    layout = Layout(docs, key, sequence, shard_rows)
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    index = via_table(write_shards(sequences(docs, layout), layout, path), "order-index")
    with store.open_output_stream(f"{folder}/{MANIFEST}") as stream:
        stream.write(json.dumps({"sequence": sequence, "key": key, "shards": layout.shards, "sequences": index.count()}).encode())
    sizes = index.groupBy("shard").agg(F.count("*").alias("n"))  # one row per shard
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first_slot"))
    return index.join(F.broadcast(starts), "shard").select(
        "doc_id", "piece", "n_tokens", (F.col("first_slot") + F.col("row")).alias("slot"), "shard",
        (F.col("row") * (2 * sequence)).alias("byte_offset"), "ids_crc32")


def read_slots(path: str, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences from slot ``start`` on, read in order from the folder alone."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
        manifest = json.loads(file.read())
    stride = 2 * manifest["sequence"]
    shards = sorted((f.path, f.size // stride) for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("shard-"))
    if sum(n for _, n in shards) != manifest["sequences"]:
        raise ValueError(f"{path}: {sum(n for _, n in shards)} sequences in the shards, {manifest['sequences']} in the manifest")
    for name, n in shards:
        if start >= n:
            start -= n
            continue
        with store.open_input_file(name) as file:
            file.seek(start * stride)
            for _ in range(start, n):
                yield np.frombuffer(file.read(stride), dtype="<u2")
        start = 0


def training_order(docs: DataFrame, key: int = 0) -> DataFrame:
    """The order of all sequences, with the shards written to the shared folder."""
    return materialise(docs, fresh_path(docs.sparkSession, "shards"), key)
