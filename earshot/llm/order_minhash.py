"""Order MinHash fingerprints, in DataFrame expressions.

A text's k-mers of words are numbered by occurrence, so a repeated k-mer is several
elements. All elements get places on a ring by a hash; each of ``SKETCHES``
equal arcs takes the first ``TUPLE`` elements from its start on (an arc with
fewer goes on into the next), puts them back in text order and hashes the tuple of their
k-mers. Two texts share a sketch when the same k-mers were picked and
stand in the same order, so the share of equal sketches falls with edits and
with rearrangement, not only with a change of content.

Everything happens inside one row: hashes and positions are packed into longs,
so that sorting is a sort of plain numbers, and occurrence numbers are found
by bisection in the sorted run of equal hashes. ``let`` binds each array once.

Null and empty texts, and texts of blanks, have no k-mer; all their sketches are 0, so they are alike.
A text with fewer words than a k-mer is one k-mer. Equal texts have equal
fingerprints. Only ``doc_id`` and ``text`` are read.

The next document is the next row by ``doc_id`` (null ids first, repeated ids by
text hash), after the last the first. Rows are dealt into blocks of consecutive
ids whose bounds are quantiles; the first rows of a block also go to the
block before it as guards, so texts are shuffled once and no task sorts
the table. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import let

KMER = 3
TUPLE = 2
SKETCHES = 64
# Low bits of a packed long hold a position, the others the hash.
PLACE_BITS = 30
# Documents of a block, and the most blocks; beyond that blocks grow and the window spills.
BLOCK_DOCS = 500
MAX_BLOCKS = 1 << 14
_LEVEL = 128

_LOW = (1 << PLACE_BITS) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _pack(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(_long(~_LOW)).bitwiseOR(place.cast("long"))


def kmers(text: Column, k: int = KMER) -> Column:
    """Hashes of the text's k-mers of words, in order."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        mers = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(n >= k, mers).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _occurrence(s: Column, x: Column, j: Column) -> Column:
    """How many elements before place ``j`` of the sorted ``s`` have the same hash as ``x``."""
    def same(back: Column) -> Column:
        other = F.when(j >= back, F.get(s, j - back))
        return F.coalesce(F.shiftright(other, PLACE_BITS) == F.shiftright(x, PLACE_BITS), F.lit(False))

    steps = F.array(*(F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda n, b: F.when(same(n + b), n + b).otherwise(n))
    return F.when(same(F.lit(1)), found).otherwise(F.lit(0))


def _ring(h: Column) -> Column:
    """Occurrence-numbered k-mers in the order of their places on the ring, each with its position in the text."""
    def numbered(s: Column) -> Column:
        return F.transform(s, lambda x, j: _pack(
            F.xxhash64(F.shiftright(x, PLACE_BITS), _occurrence(s, x, j)), x.bitwiseAND(_long(_LOW))))

    return F.sort_array(let(F.sort_array(F.transform(h, _pack)), numbered))


def _tuples(h: Column, g: Column, sketches: int, size: int) -> Column:
    shift = 64 - (sketches.bit_length() - 1)
    n = F.size(g)

    def arc(x: Column) -> Column:
        return F.shiftright(x, shift).cast("int") + sketches // 2

    def of_arcs(starts: Column) -> Column:
        def sketch(known: Column) -> Column:
            def one(b: Column) -> Column:
                at = F.array_position(known, b).cast("int")
                later = F.get(F.filter(starts, lambda j: arc(F.get(g, j)) > b), F.lit(0))
                start = F.when(at > 0, F.get(starts, at - 1)).otherwise(F.coalesce(later, F.lit(0)))

                def picked(s: Column) -> Column:
                    places = F.array(*(F.get(g, (s + t) % n).bitwiseAND(_long(_LOW)).cast("int") for t in range(size)))
                    return let(F.sort_array(places), lambda p: F.xxhash64(*(F.get(h, F.get(p, F.lit(t))) for t in range(size))))

                return let(start, picked).bitwiseAND(_long(0xFFFF)).cast("int")

            return F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), one)

        return let(F.transform(starts, lambda j: arc(F.get(g, j))), sketch)

    first = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (arc(F.get(g, j)) != arc(F.get(g, j - 1))))
    return let(first, of_arcs)


def sketches_of(text: Column, k: int = KMER, sketches: int = SKETCHES, size: int = TUPLE) -> Column:
    """The fingerprint as an array of 16-bit numbers. ``sketches`` is a power of two."""
    none = F.array_repeat(F.lit(0), sketches)
    return let(kmers(text, k), lambda h: F.when(F.size(h) == 0, none).otherwise(
        let(_ring(h), lambda g: _tuples(h, g, sketches, size))))


def as_text(sketches: Column) -> Column:
    """Four hex digits per sketch."""
    return F.lower(F.array_join(F.transform(sketches, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id, _long(-(1 << 63)))


def block_bounds(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> list[int]:
    """The first order key of each block. All are keys of rows; at most ``MAX_BLOCKS``."""
    n, low = docs.agg(F.count("*"), F.min(_order(F.col("doc_id")))).first()
    if not n:
        return []
    blocks = min(MAX_BLOCKS, -(-n // block_docs))
    shares = [i / blocks for i in range(1, blocks)]
    if not shares:
        return [low]
    # An array of quantiles costs one pass over the ids alone.
    inner = docs.agg(F.percentile_approx(_order(F.col("doc_id")), shares, max(10_000, 20 * blocks))).first()[0]
    return sorted({low, *inner})


def with_next(rows: DataFrame, columns: list[str], bounds: list[int]) -> DataFrame:
    """``rows`` (``doc_id, text, ..``) with ``next_<column>`` of the next document."""
    if not bounds:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    coarse = F.array(*(_long(b) for b in bounds[::_LEVEL]))
    all_bounds = F.array(*(_long(b) for b in bounds))
    key = _order(F.col("doc_id"))
    level = F.size(F.filter(coarse, lambda b: b <= F.col("__key"))) - 1
    fine = F.size(F.filter(F.slice(all_bounds, F.col("__level") * _LEVEL + 1, _LEVEL), lambda b: b <= F.col("__key")))
    told = rows.withColumn("__key", key).withColumn("__level", level).withColumn(
        "__block", F.col("__level") * _LEVEL + fine - 1)
    own = F.struct(F.col("__block").alias("block"), F.lit(False).alias("guard"))
    before = F.struct(F.pmod(F.col("__block") - 1, F.lit(len(bounds))).alias("block"), F.lit(True).alias("guard"))
    dealt = told.withColumn("__to", F.explode(
        F.when(F.get(all_bounds, F.col("__block")) == F.col("__key"), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "__key", F.col("__to.block").alias("__in"), F.col("__to.guard").alias("__guard"),
                         F.xxhash64("text").alias("__tie"))
    order = Window.partitionBy("__in").orderBy("__guard", "__key", "__tie")
    led = dealt.select(*rows.columns, "__guard", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.filter(~F.col("__guard")).drop("__guard")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = block_bounds(docs.select("doc_id"))
    rows = with_next(texts.withColumn("sketches", sketches_of(F.col("text"))), ["text", "sketches"], bounds)
    n = F.char_length("text")
    changed = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - changed), F.substring("next_text", F.lit(1), changed))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketches",
                       likeness(F.col("sketches"), F.col("next_sketches")).alias("near_next"))
    rows = rows.select("*", sketches_of(F.col("edited")).alias("edited_sketches"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       as_text(F.col("sketches")).alias("fingerprint"),
                       as_text(F.col("edited_sketches")).alias("edited_fingerprint"),
                       likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"), "near_next")
