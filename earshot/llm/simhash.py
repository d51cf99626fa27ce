"""SimHash near-duplicates by covering locality-sensitive hashing.

A random linear map sends the 64 bit places to vectors of radius + 1 bits; each
of the 2^(radius+1) - 1 non-zero vectors v gives a mask of the places whose
image has an odd product with v. For any set of at most ``radius`` places some
v is orthogonal to all their images, so two fingerprints within the radius agree under
that mask: every such pair meets in at least one bucket.

Buckets hold distinct fingerprints, so exact copies are one entry. Inside a
bucket no pairs are written out. All members within the radius of the
bucket's smallest one are linked to it; after components are formed, only
buckets that still hold several components are looked at again: those of at most
``GROUP_LIMIT`` members in one vectorised comparison, the larger ones by
covering masks of their own, which keep more bits, until nothing is left.
Links are always verified by counting bits, so components are exact.

Null and empty texts, and texts of blanks, have fingerprint zero, which links
like any other. Equal fingerprints are one class; rows that repeat a
``doc_id`` are one document in a class's name. Null ids are no class names unless a class has
nothing else. Very long texts are hashed whole, ``_CHUNK`` shingles at a time. Where one document of
each class is kept, rows are told apart by id and text, ids before null ones and then the smallest, and equal
rows are one. Empty tables give empty results.
Only ``doc_id`` and ``text`` are read; other columns pass through ``one_of_each`` under any name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import per_text, text_id, whole_rows
from earshot.llm.components import components
from earshot.session import via_table

RADIUS = 4
SHINGLE = 4
SEED = 42
# Members of a bucket that one task compares with each other; larger buckets are divided by further masks.
GROUP_LIMIT = 2048
# Shingles hashed before their bits are added up.
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII rules for bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends, end = [], -1
    for word in words:
        end += len(word) + 1
        ends.append(end)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - size + 1)
    ends = ends[min(size, len(words)) - 1:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[low:low + _CHUNK], ends[low:low + _CHUNK])],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(rows: Iterator[tuple]) -> Iterator[tuple]:
    for *keys, text in rows:
        yield *keys, np.uint64(fingerprint(text)).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    return per_text(docs, ["doc_id", "text"], "doc_id long, fp long", _fingerprints, 10_000)


def covering_masks(radius: int = RADIUS, seed: int = 0, places: int = 64) -> list[int]:
    """2^(radius+1) - 1 signed 64-bit masks; any ``radius`` places are all outside at least one of them.

    The images are dealt evenly over all vectors, so that the masks keep
    similar numbers of bits.
    """
    size = 1 << (radius + 1)
    images = [i % size for i in range(places)]
    random.Random(seed).shuffle(images)
    masks = (sum(1 << i for i, m in enumerate(images) if (m & v).bit_count() % 2) for v in range(1, size))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _links_within(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """For each bucket's members and their labels, one link for each two labels that meet within the radius."""
    for frame in frames:
        found = []
        for members in frame["members"]:
            fps = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
            _, groups = np.unique(np.array([m["label"] for m in members], dtype=np.int64), return_inverse=True)
            if len(fps) < 2:
                continue
            met = set()
            for i in range(len(fps) - 1):
                near = np.flatnonzero((np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius) & (groups[i + 1:] != groups[i]))
                for j in near + i + 1:
                    pair = (min(groups[i], groups[j]), max(groups[i], groups[j]))
                    if pair not in met:
                        met.add(pair)
                        found.append((fps[i].astype(np.int64), fps[j].astype(np.int64)))
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _shared(buckets: DataFrame) -> DataFrame:
    """``bucket, fp, hub, n`` for buckets of two members or more.

    Spark sizes the rows that ``explode`` adds as none, so without the hint it may broadcast a row for each fingerprint and mask.
    """
    sizes = buckets.groupBy("bucket").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return via_table(buckets.hint("merge").join(sizes, "bucket"), "shared-buckets")


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component of ``links``, with ``label``."""
    labels = components(links).select(F.col("node").alias("fp"), "label")
    told = shared.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    return via_table(told.join(mixed.select("bucket"), "bucket", "left_semi"), "open-buckets")


def links(prints: DataFrame, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``a, b``: verified links that connect distinct fingerprints ``fp`` exactly as all links would."""
    mask = F.explode(F.array(*(F.lit(m) for m in covering_masks(radius)))).alias("mask")
    buckets = prints.select("fp", mask).select("fp", "mask").withColumn(
        "bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
    # The full mask of a bucket is kept only where it may be divided further.
    shared = _shared(buckets)
    found = via_table(shared.filter((F.col("fp") != F.col("hub")) & (_differing("fp", "hub") <= radius)).select(
        F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "hub-links")
    level = 0
    while True:
        level += 1
        open_ = _labelled(shared, found)
        small = open_.filter(F.col("n") <= limit).groupBy("bucket").agg(
            F.collect_list(F.struct("fp", "label")).alias("members"))
        exact = small.select("members").mapInPandas(lambda f: _links_within(f, radius), "a long, b long")
        found = via_table(found.union(exact).distinct(), "links")
        large = open_.filter(F.col("n") > limit)
        if large.isEmpty():
            return found
        finer = F.explode(F.array(*(F.lit(m) for m in covering_masks(radius, level)))).alias("finer")
        divided = large.select("bucket", "fp", "mask", finer).withColumn(
            "mask", F.col("mask").bitwiseOR(F.col("finer"))).withColumn(
            "bucket", F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask")))).select("fp", "mask", "bucket")
        shared = _shared(divided)
        found = via_table(found.union(shared.filter(
            (F.col("fp") != F.col("hub")) & (_differing("fp", "hub") <= radius)).select("fp", "hub")).distinct(), "links")


def class_labels(classes: DataFrame, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``classes`` (one row per ``fp``) with ``label``, the same for all that links of at most ``radius`` bits connect."""
    labels = components(links(classes.select("fp"), radius, limit)).select(F.col("node").alias("fp"), "label")
    return classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest document reachable over links of at most ``radius`` bits."""
    prints = via_table(fingerprints(docs), "fingerprints")
    classes = via_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    told = class_labels(classes, radius, limit)
    names = told.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = via_table(told.join(names, "label").select("fp", "component_id"), "class-names")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns."""
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), text_id(), "text")
    prints = via_table(per_text(rows, ["no_id", "id", "text_id", "text"], "no_id boolean, id long, text_id long, fp long",
                                _fingerprints, 10_000), "fingerprints")
    # The smallest row of a fingerprint, then the smallest of its class: nothing but those is shuffled twice.
    classes = via_table(prints.groupBy("fp").agg(F.min(F.struct("no_id", "id", "text_id")).alias("first")), "classes")
    firsts = via_table(class_labels(classes, radius, limit).groupBy("label").agg(F.min("first").alias("first")).select("first.*"), "firsts")
    key = ["no_id", "id", "text_id"]
    keyed = whole_rows(docs, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), text_id())
    return keyed.join(firsts, key, "left_semi").dropDuplicates(key).select("row.*")
