"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints within the radius agree
in one segment up to ``radius // segments`` bits, so each fingerprint looks up every
value of that small Hamming ball in the segment's table and the whole distance is then
checked. Two segments of 32 bits keep a table entry rare even among billions of texts.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import LOWER, cut, over_slices, read_documents, texts
from oddsgraph.llm.components import components

SEED = 42
BITS = 64
SEGMENTS = 2
HOT_BUCKET = 2048
"""A segment value with more fingerprints is searched by whole balls instead: about their size."""
_CHUNK = 1 << 15
_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint as a signed number: a bit is 1 if it is set in over half the shingle hashes."""
    tokens = text.encode().translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    while chunk := [digest(s, SEED) for s in islice(shingles, _CHUNK)]:
        bits = np.unpackbits(np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(chunk)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(ids: list[int], bodies: list[str]) -> dict[str, list]:
        return {"doc_id": ids, "fp": [simhash(t, words) for t in bodies]}

    return texts(docs).mapInArrow(over_slices(run, _OUT), "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    """Every mask of at most ``radius`` of ``width`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _segment(value: F.Column, k: int, segments: int) -> F.Column:
    width = BITS // segments
    return F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1))


def near_fingerprints(distinct: DataFrame, radius: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    Exact. A segment value that very many fingerprints share is not paired with itself:
    its members list their whole ball of 64 bits and meet the others by equality, which
    costs the same for each however many they are.
    """
    if BITS % segments or segments < 2:
        raise ValueError("segments must divide the fingerprint")
    masks = F.lit(_ball(BITS // segments, radius // segments))
    keys = F.array(*[F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), k, segments).alias("value")) for k in range(segments)])
    table = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.seg", "key.value")
    hot = table.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("seg", "value")
    hot = cut(hot)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    probes = table.select(F.col("fp").alias("a"), "seg", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    entries = table.withColumnRenamed("fp", "b")
    crowded = not hot.isEmpty()
    if crowded:
        entries = entries.join(hot, ["seg", "value"], "left_anti")
    pairs = probes.join(entries, ["seg", "value"]).where("a < b").where(close).select("a", "b")
    if crowded:
        members = table.join(hot, ["seg", "value"], "left_semi").select(F.col("fp").alias("x")).distinct()
        whole = F.explode(F.transform(F.lit(_ball(BITS, radius)), lambda m: F.col("x").bitwiseXOR(m)))
        met = members.select("x", whole.alias("fp")).join(distinct, "fp").where("x != fp")
        pairs = pairs.union(met.select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that can be reached over fingerprints ``radius`` bits apart.

    Null and empty texts have fingerprint zero and link like any other. Copies are one
    fingerprint, so a group of any size is one node. Fingerprints are the nodes: rows without
    doc_id pass links on, come out with the component of their fingerprint and name none (null
    where all rows of a component lack a doc_id). Repeated rows come out repeated.
    """
    marks = cut(fingerprints(docs, words))
    least = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_fingerprints(least.select("fp"), radius))
    named = cut(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(first, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays, once.

    Rows without doc_id stay, once for each text.
    """
    found = near_duplicates(docs, words, radius)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    whole = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    kept = docs.join(gone, "doc_id", "left_anti").withColumn("__text", whole)
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
