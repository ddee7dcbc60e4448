"""Quality by importance resampling: keep what a target model would rather write than the raw one.

Words (and runs of punctuation) and pairs of them are hashed into 2^18 buckets. Three generative models of these
buckets are learned: raw (all documents), target (documents labelled good and not toxic)
and toxic (documents labelled toxic). Target is drawn towards raw where it has seen little. The toxic
model counts documents, not occurrences, and differs from raw only in buckets that stand
out beyond chance and make a document more likely toxic than not. The importance weight of
a document is log target - log raw. A document that is more likely toxic than not, by
toxic against raw and the labelled share, has no weight; of the others Gumbel top-k draws
k without replacement: the k largest of log weight + Gumbel noise, the noise a hash of
doc_id and text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import LOWER, cut, read_documents, slices, texts, utf8

HALF_BITS = 17
BUCKETS = 2 << HALF_BITS
SAMPLE = 50_000
"""Labelled documents of each kind that the target and the toxic model are learned from, at most."""
DRAWN_TO_RAW = 1_000_000.0
LIKELY = math.log(0.5)
LEAST_SHARE = 0.02
"""Of the toxic documents, how many must hold a bucket that counts."""
BEYOND_CHANCE = 5.0
"""Standard deviations by which a bucket's count among toxic documents must stand out."""
FEW = 1_000_000
PART = 4096
"""Buckets that go from a task to its sum in one row."""
RAW, GOOD, RAW_DOCS, TOXIC_DOCS = range(4)
_FOLD = np.frombuffer(LOWER, np.uint8)
# 0: white space; 1: letters, digits and all beyond ASCII; 2: the rest, so that punctuation is words of its own.
_KIND = np.array([0 if c in b"\t\n\x0b\x0c\r " else 1 if c > 127 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PARTS = pa.schema([("first", pa.int32()), ("counts", pa.binary())])
_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("log_toxic", pa.float64()), ("n_features", pa.int64()), ("noise_seed", pa.int64())])


@dataclass(frozen=True)
class Models:
    """Log ratios to the raw model by bucket, and the log share of toxic documents among the labels."""

    good: np.ndarray
    toxic: np.ndarray
    prior: float


def fit(counts: np.ndarray, n_docs: int, n_toxic: int, prior: float) -> Models:
    """From bucket counts: occurrences in raw and good, documents with it in raw and toxic."""
    raw = (counts[RAW] + 0.1) / (counts[RAW].sum() + 0.1 * BUCKETS)
    good = np.log((counts[GOOD] + DRAWN_TO_RAW * raw) / (counts[GOOD].sum() + DRAWN_TO_RAW)) - np.log(raw)
    due = n_toxic * counts[RAW_DOCS] / max(1, n_docs)
    stands_out = counts[TOXIC_DOCS] - due > BEYOND_CHANCE * np.sqrt(due + 1.0)
    stands_out &= counts[TOXIC_DOCS] >= LEAST_SHARE * n_toxic
    ratio = np.log(np.maximum(counts[TOXIC_DOCS], 1.0) / np.maximum(due, 1e-9))
    toxic = np.where(stands_out & (ratio + prior > LIKELY), ratio, 0.0)
    return Models(good.astype(np.float32), toxic.astype(np.float32), prior)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            _powers[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, lower case in A to Z, and how many each text has."""
    n, base = len(offsets) - 1, int(offsets[0])
    body = _FOLD[data[base : int(offsets[-1])]]
    edges = offsets - base
    kind = _KIND[body]
    solid = kind > 0
    opens = solid.copy()
    opens[1:] &= kind[1:] != kind[:-1]
    first = edges[:-1][edges[:-1] < len(body)]
    opens[first] = solid[first]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    powers, back = _power(len(body) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(solid, body.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[:-1])])
    words = _mixed((sums[np.append(starts[1:], len(body))] - sums[starts]) * back[starts])
    of = np.searchsorted(edges, starts, "right") - 1
    pair = of[1:] == of[:-1]
    pairs = _mixed(words[:-1] * np.uint64(31) + words[1:])[pair]
    shift = np.uint64(64 - HALF_BITS)
    found = np.concatenate([words >> shift, (pairs >> shift) + np.uint64(BUCKETS // 2)]).astype(np.int64)
    owner = np.concatenate([of, of[1:][pair]])
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=n)


def _few(labels: DataFrame, wanted: F.Column) -> DataFrame:
    """At most SAMPLE labelled doc_ids, those with the smallest hash."""
    ids = labels.where(wanted & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def _parts(counts: np.ndarray) -> pa.RecordBatch:
    """A table of counts (models by buckets) in rows of PART buckets: bytes of equal weight together, most of them zero, compressed."""
    firsts = range(0, counts.shape[1], PART)
    data = [zlib.compress(counts[:, a : a + PART].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for a in firsts]
    return pa.RecordBatch.from_pydict({"first": list(firsts), "counts": data}, schema=_PARTS)


def _read_part(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(4, -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: parts of one range of buckets added up as they come; the whole table at most is held."""
    counts = np.zeros((4, BUCKETS + 1), np.int64)
    seen = set()
    for batch in batches:
        for first, data in zip(batch.column("first").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = _read_part(data)
            counts[:, first : first + part.shape[1]] += part
            seen.add(first)
    if seen:
        whole = _parts(counts)
        yield whole.filter(pa.array([first in seen for first in whole.column("first").to_pylist()]))


def learn(docs: DataFrame, labels: DataFrame) -> Models:
    """Learn from ``docs`` and ``labels`` (doc_id, quality, toxic).

    Raw occurrences cover every document; documents and the labelled share are counted in
    distinct texts. The labelled ones are a sample of bounded size, so
    their ids are broadcast; texts move once, to meet their copies. Tasks add up in tables of fixed size, which go on
    compressed, and the driver gets four numbers for each bucket at most.
    """
    good, toxic = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.col("toxic") == 1
    known = cut(_few(labels, good).withColumn("kind", F.lit(GOOD)).union(_few(labels, toxic).withColumn("kind", F.lit(TOXIC_DOCS))).groupBy("doc_id").agg(F.max("kind").alias("kind")))
    # Copies of one document would pass for evidence: each text counts once, but for the occurrences in raw.
    rows = texts(docs).withColumn("body", F.xxhash64("text"))
    marked = rows.join(F.broadcast(known), "doc_id", "left").groupBy("body")
    marked = marked.agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.coalesce(F.max("kind"), F.lit(RAW)).cast("long").alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((4, BUCKETS), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            kinds, copies = batch.column("kind").to_numpy(), batch.column("copies").to_numpy()
            for a, b in slices(offsets):
                found, sizes = features(data, offsets[a : b + 1])
                kind, of = kinds[a:b], np.repeat(np.arange(b - a), sizes)
                once = np.unique(of * BUCKETS + found)
                counts[RAW] += np.bincount(found, copies[a:b][of], BUCKETS).astype(np.int64)
                for k, some in ((GOOD, found[kind[of] == GOOD]), (RAW_DOCS, once % BUCKETS), (TOXIC_DOCS, once[kind[once // BUCKETS] == TOXIC_DOCS] % BUCKETS)):
                    counts[k] += np.bincount(some, minlength=BUCKETS)
                n += [0, 0, b - a, (kind == TOXIC_DOCS).sum()]
        yield _parts(np.column_stack([counts, n]))

    parts = marked.mapInArrow(run, "first int, counts binary").repartition("first").mapInArrow(_summed, "first int, counts binary")
    counts = np.zeros((4, BUCKETS + 1))  # the last column has the numbers of documents
    for row in parts.toArrow().to_pylist():
        part = _read_part(row["counts"])
        counts[:, row["first"] : row["first"] + part.shape[1]] = part
    judged = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    judged = rows.select("doc_id", "body").join(judged, "doc_id").groupBy("body").agg(F.max(toxic).alias("toxic"))
    seen = judged.agg(F.count("*").alias("n"), F.count_if("toxic").alias("toxic")).head()
    n = counts[:, -1].astype(int)
    return fit(counts[:, :-1], n[RAW_DOCS], n[TOXIC_DOCS], math.log((seen["toxic"] + 0.5) / (seen["n"] + 1.0)))


def _weigh(column: pa.Array, models: Models) -> dict[str, np.ndarray]:
    data, offsets = utf8(column)
    found, sizes = features(data, offsets)
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values[found].astype(np.float64))])
        return sums[ends[1:]] - sums[ends[:-1]]

    return {"log_weight": total(models.good), "log_toxic": total(models.toxic) + models.prior, "n_features": sizes}


def weights(docs: DataFrame, models: Broadcast, seed: int = 7) -> DataFrame:
    """(doc_id, log_weight, log_toxic, n_features, key) of every row.

    ``log_weight`` is log target - log raw of the whole text, ``log_toxic`` the log of
    the estimated probability of being toxic, ``key`` is the weight with Gumbel noise. A null or empty text has
    weight 0. Repeated rows have equal keys.
    """
    rows = texts(docs, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)).alias("noise_seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(utf8(column)[1]):
                out = _weigh(column.slice(a, b - a), models.value)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **out, "noise_seed": part.column("noise_seed")}, schema=_WEIGHTS)

    found = rows.mapInArrow(run, "doc_id long, log_weight double, log_toxic double, n_features long, noise_seed long")
    even = (F.shiftrightunsigned("noise_seed", 11) + 0.5) / float(1 << 53)
    return found.select("doc_id", "log_weight", "log_toxic", "n_features", (F.col("log_weight") - F.log(-F.log(even))).alias("key"))


def largest(rows: DataFrame, key: str, k: int, ties: list[str]) -> DataFrame:
    """Exactly the ``k`` rows with the largest keys (ties by ``ties``), without sorting them all.

    ``rows`` must be written. Quantiles bracket the k-th key until few rows are left around
    it; only those are sorted.
    """
    n = rows.count()
    if k >= n:
        return rows
    around, above, share = rows, None, 0.002
    while n > FEW:
        at = 1 - k / n
        low, high = around.approxQuantile(key, [max(0.0, at - 2 * share), min(1.0, at + 2 * share)], share / 2)
        sure = around.where(F.col(key) > high)
        narrower = around.where(F.col(key).between(low, high))
        taken, left = sure.count(), narrower.count()
        if taken > k or taken + left < k or left == n:
            break  # ties; sort what is left
        above = sure if above is None else above.union(sure)
        around, k, n = narrower, k - taken, left
    rest = around.orderBy(F.col(key).desc(), *ties).limit(k)
    return rest if above is None else above.union(rest)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, log_weight, log_toxic, n_features, key) of the documents drawn.

    ``share`` of all rows are drawn; by default the share of good documents among the
    labels. Fewer come out only if fewer are not toxic. Without labels nothing is known to
    be better, and weights are noise alone.
    """
    models = learn(docs, labels)
    if share is None:
        seen = labels.where("quality is not null").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).head()
        share = seen["good"] / seen["n"] if seen["n"] else 1.0
    found = cut(weights(docs, docs.sparkSession.sparkContext.broadcast(models)))
    k = round(found.count() * share)
    clean = found.where(F.col("log_toxic") <= LIKELY)
    return largest(clean, "key", k, ["doc_id"])


def op8_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
