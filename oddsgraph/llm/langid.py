"""Which languages a document mixes, and how much of each.

Every letter stands for the trigram around it; a word's likelihood under a language is the
product of its trigrams'. A document is a mixture: expectation-maximisation over its words
finds the proportions of a set of languages, and the set grows by the language with the
steepest gain in likelihood as long as the gain pays the penalty of one more proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import read_documents, slices, texts, utf8

BUCKET_BITS = 16
SMOOTHING = 0.1
ROUNDS = 15
SETTLED = 1e-3
MOST_LANGUAGES = 1000
UNDECIDED = "und"
_LETTERS = 1 << 20
_COUNTS = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
_TINY = 1e-300


@dataclass(frozen=True)
class Model:
    """``table[bucket, k]`` is the log likelihood of a trigram bucket under ``languages[k]``."""

    languages: list[str]
    table: np.ndarray


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point to lower-case letter; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            table[code] = ord(c.lower()[0])
    return table


def _codes(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, each followed by a gap, and the end of each text."""
    joined = "\n".join([*bodies, ""]).encode("utf-32-le", "replace")
    return _fold()[np.frombuffer(joined, np.uint32)], np.cumsum([len(t) + 1 for t in bodies])


def _buckets(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each letter position; the last code is a gap."""
    c = codes.astype(np.uint64)
    mixed = np.roll(c, 1)[at] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _pieces(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of about a million codes that end in a gap, so that memory doesn't follow the longest text."""
    at = 0
    while at < len(codes):
        stop = min(len(codes), at + _LETTERS)
        gap = np.flatnonzero(codes[stop - 1 :] == 0)
        stop += int(gap[0]) if len(gap) else 0
        yield at, codes[at:stop]
        at = stop


def train(docs: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Learn from the columns ``text`` and ``lang``; rows without a lang teach nothing.

    All rows count: tasks sum trigrams in a table of fixed size, tables are added up by
    Spark, and the driver gets at most 2^16 numbers for each language.
    """
    labelled = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place, size = {name: k for k, name in enumerate(languages)}, 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            names, column = batch.column("lang").to_pylist(), batch.column("text")
            for a, b in slices(utf8(column)[1]):
                bodies = column.slice(a, b - a).to_pylist()
                for name in set(names[a:b]):
                    codes, _ = _codes([t for t, n in zip(bodies, names[a:b], strict=True) if n == name])
                    for _, part in _pieces(codes):
                        found = np.bincount(_buckets(part, np.flatnonzero(part)), minlength=size)
                        k = place[name]
                        counts[k] = counts[k] + found if k in counts else found
        for k, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"language": [k] * len(at), "bucket": at.astype(np.int32), "n": found[at]}, schema=_COUNTS)

    parts = labelled.mapInArrow(run, "language int, bucket int, n long")
    total = parts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size, len(languages)))
    counts[total["bucket"].to_numpy(), total["language"].to_numpy()] = total["n"].to_numpy()
    table = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * size)) if languages else counts
    return Model(languages, table.astype(np.float32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _fit(like: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document by expectation-maximisation from ``share``, and the log likelihood."""
    sizes = np.diff(np.append(starts, len(like)))
    of = np.repeat(np.arange(len(starts)), sizes)
    for _ in range(ROUNDS):
        part = like * share[of]
        part /= np.maximum(part.sum(axis=1, keepdims=True), _TINY)
        new = _sums(part, starts) / sizes[:, None]
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    return share, _sums(np.log(np.maximum(np.einsum("ij,ij->i", like, share[of]), _TINY)), starts)


def mixtures(words: np.ndarray, starts: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Proportions (documents x languages) from log likelihoods (words x languages).

    ``starts`` is the first word of each document. A language joins the set if the log
    likelihood gains more than ``penalty * log(number of words)``.
    """
    like = np.exp(words - words.max(axis=1, keepdims=True))
    share = np.zeros((len(starts), words.shape[1]))
    share[np.arange(len(starts)), _sums(words, starts).argmax(axis=1)] = 1.0
    left = np.arange(len(starts))
    for _ in range(words.shape[1] - 1):
        sizes = np.diff(np.append(starts, len(like)))
        of = np.repeat(np.arange(len(starts)), sizes)
        now = np.maximum(np.einsum("ij,ij->i", like, share[left][of]), _TINY)
        before = _sums(np.log(now), starts)
        # A mixture gains by a language if and only if its mean likelihood ratio is above one.
        gain = _sums(like / now[:, None], starts) / sizes[:, None]
        gain[share[left] > 0] = 0
        best = gain.argmax(axis=1)
        trying = gain.max(axis=1) > 1
        if not trying.any():
            break
        keep = trying[of]
        like, sizes, best, before, left = like[keep], sizes[trying], best[trying], before[trying], left[trying]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        guess = share[left] * 0.9
        guess[np.arange(len(left)), best] += 0.1
        fitted, after = _fit(like, starts, guess)
        better = after - before > penalty * np.log(sizes)
        share[left[better]] = fitted[better]
        if not better.any():
            break
        keep = np.repeat(better, sizes)
        like, sizes, left = like[keep], sizes[better], left[better]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return share


def _word_likelihoods(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of all words, and where each begins."""
    found, places = [], []
    for base, part in _pieces(codes):
        at = np.flatnonzero(part)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            found.append(_sums(table[_buckets(part, at)], first).astype(np.float64))
            places.append(at[first] + base)
    if not found:
        return np.zeros((0, table.shape[1])), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def predict(bodies: list[str], model: Model, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text (all zero where nothing can be said) and its number of words."""
    share = np.zeros((len(bodies), max(1, len(model.languages))))
    codes, ends = _codes(bodies)
    words, places = _word_likelihoods(codes, model.table if model.languages else np.zeros((1 << BUCKET_BITS, 1), np.float32))
    sizes = np.diff(np.searchsorted(places, ends, "left"), prepend=0)
    some = np.flatnonzero(sizes)
    if len(some) and model.languages:
        share[some] = mixtures(words, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), penalty)
    return share, sizes


def languages(docs: DataFrame, model: Broadcast, penalty: float = 0.5) -> DataFrame:
    """``docs`` with lang_pred, score (its proportion, 0 to 1) and n_words, as struct column ``__language``.

    ``und`` with score 0: the text is null or has no letter, or no language was learned.
    Only ``text`` is looked at. Ties go to the language first in the alphabet. A broadcast
    model is of bounded size: 2^16 numbers for each language.
    """
    schema = docs.select("*", F.lit(None).cast("struct<lang_pred:string,score:double,n_words:long>").alias("__language")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.languages
        limit = max(1 << 16, (4 << 20) // max(4, len(names)))
        for batch in batches:
            column = batch.column("text").fill_null("")
            for a, b in slices(utf8(column)[1], limit):
                share, sizes = predict(column.slice(a, b - a).to_pylist(), model.value, penalty)
                best, score = share.argmax(axis=1), share.max(axis=1)
                found = [names[k] if s > 0 else UNDECIDED for k, s in zip(best, score, strict=True)]
                out = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sizes.astype(np.int64))], ["lang_pred", "score", "n_words"])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, "__language"])

    return docs.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32(doc_id as text) leaves this remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def reject(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents of which one language makes up at least the share ``least``.

    Documents without a letter go. Where no row has a lang there is nothing to tell
    languages apart by, and all documents with letters stay.
    """
    model = train(docs)
    kept = F.col("__language.n_words") > 0
    if model.languages:
        kept &= F.col("__language.score") >= least
    return languages(docs, docs.sparkSession.sparkContext.broadcast(model)).where(kept).select(*docs.columns)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = train(docs.where(~held_out(3, 1)))
    found = languages(texts(docs), spark.sparkContext.broadcast(model))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "__language.lang_pred", "__language.score")
