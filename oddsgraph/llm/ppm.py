"""Log probabilities of documents by prediction by partial matching, beside a word count base.

A trie of byte contexts, up to five bytes long, counts which byte follows, in texts with A
to Z in lower case. A byte that was
seen after its longest known context has probability c / (T + d) there, with T the total
and d the number of distinct followers; otherwise the model escapes with d / (T + d) to
the next shorter context, in which all followers of the longer one are excluded, and at
last to equal shares of the symbols left. Texts start after five marks that occur in no
text and end with an end symbol, so a score is a probability of the whole text.

The trie is a table: a row for each context with a follower and for each context. The
commonest entries, a bounded number, are broadcast and score almost every byte inside
the tasks; the rest, and whatever was never seen, is looked up by shuffled joins. So the
result is that of the whole trie whatever its size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import LOWER, cut, read_documents, read_files, slices, texts, utf8
from oddsgraph.llm.langid import held_out

ORDER = 5
SYMBOLS = 257
"""Byte values that UTF-8 uses or may use, and the end."""
HOT_GRAMS = 2_000_000
HOT_WORDS = 250_000
END_WORD = b"\n"
"""Stands for the end of a document among words, which hold no white space."""
_START, _END = 0xFE, 0xFF
_FOLD = np.frombuffer(LOWER, np.uint8)
_HELD_WORDS, _HELD_GRAMS = 300_000, 4_000_000
_COUNTS = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_SCORES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of each text the byte with those before it, as one number; where each text begins."""
    sizes, n = np.diff(offsets), len(offsets) - 1
    heads = np.arange(n) * (ORDER + 1) + ORDER + offsets[:-1] - offsets[0]
    out = np.full(int(sizes.sum()) + n * (ORDER + 1), _START, np.uint64)
    body = np.arange(int(sizes.sum())) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, sizes)
    out[body] = _FOLD[data[offsets[0] : offsets[-1]]]
    out[heads + sizes] = _END
    keys = np.zeros(len(out), np.uint64)
    for back in range(ORDER + 1):
        keys[back:] |= out[: len(out) - back] << np.uint64(8 * back)
    inside = np.ones(len(out), bool)
    inside[(heads[:, None] - 1 - np.arange(ORDER)).ravel()] = False
    return keys[inside].astype(np.int64), np.cumsum(sizes + 1) - sizes - 1


def tokens(text: str) -> list[bytes]:
    """Words, lower case in A to Z alone."""
    return text.encode().translate(LOWER).split()


def words_of(text: str) -> Counter:
    """Counts of the words and of one end."""
    found = Counter(tokens(text))
    found[END_WORD] = 1
    return found


def _strings(words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def count(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (gram, n) over all whole texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def word_rows() -> pa.RecordBatch:
            n = len(words)
            return pa.RecordBatch.from_arrays([_strings(words), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], schema=_COUNTS)

        def gram_rows() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            totals = np.bincount(inverse, np.concatenate([n for _, n in kept]), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys), pa.array(totals)], schema=_COUNTS)

        for batch in batches:
            column = batch.column("text")
            data, offsets = utf8(column)
            for a, b in slices(offsets):
                bodies = column.slice(a, b - a).to_pylist()
                words.update(chain.from_iterable(map(tokens, bodies)))
                words[END_WORD] += len(bodies)
                found = np.unique(grams(data, offsets[a : b + 1])[0], return_counts=True)
                kept.append(found)
                held += len(found[0])
                if len(words) > _HELD_WORDS:
                    yield word_rows()
                    words.clear()
                if held > _HELD_GRAMS:
                    yield gram_rows()
                    kept, held = [], 0
        if words:
            yield word_rows()
        if kept:
            yield gram_rows()

    parts = training.select("text").mapInArrow(run, "word string, gram long, n long")
    table = cut(parts.groupBy("word", "gram").agg(F.sum("n").alias("n")))
    return table.where("word is not null").select("word", "n"), table.where("gram is not null").select("gram", "n")


def _low(value: Column, n: Column | int) -> Column:
    """The last ``n`` bytes of a number."""
    bits = (F.lit(8) * n).cast("int")
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def trie(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (level, pair, ctx, c) and contexts (level, ctx, total, followers, up_total, up_followers).

    A level is the length of a context. ``up_*`` are total and followers of the next
    shorter context without the followers of this one.
    """
    levels = F.sequence(F.lit(0), F.lit(ORDER))
    pairs = counts.select("n", "gram", F.explode(levels).alias("level")).groupBy("level", _low(F.col("gram"), F.col("level") + 1).alias("pair")).agg(F.sum("n").alias("c"))
    pairs = cut(pairs.select("level", "pair", F.shiftrightunsigned("pair", 8).alias("ctx"), "c"))
    shorter = pairs.select((F.col("level") + 1).alias("level"), F.col("pair").alias("suffix"), F.col("c").alias("up"))
    keyed = pairs.withColumn("suffix", F.when(F.col("level") > 0, _low(F.col("pair"), F.col("level"))))
    nodes = keyed.join(shorter, ["level", "suffix"], "left").groupBy("level", "ctx").agg(
        F.sum("c").alias("total"), F.count("*").alias("followers"), F.sum("up").alias("shared")
    )
    nodes = cut(nodes)
    above = nodes.select((F.col("level") + 1).alias("level"), F.col("ctx").alias("suffix"), F.col("total").alias("t"), F.col("followers").alias("f"))
    nodes = nodes.withColumn("suffix", F.when(F.col("level") > 0, _low(F.col("ctx"), F.col("level") - 1)))
    nodes = nodes.join(above, ["level", "suffix"], "left")
    return pairs, cut(
        nodes.select("level", "ctx", "total", "followers", (F.col("t") - F.col("shared")).alias("up_total"), (F.col("f") - F.col("followers")).alias("up_followers"))
    )


def _commonest(table: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the largest counts: all, or about ``most`` at the most (bounded by the quantile's error)."""
    n = table.count()
    if n <= most:
        return table
    return table.where(F.col(by) > table.approxQuantile(by, [1 - most / n], 0.05 * most / n)[0])


@lru_cache(maxsize=1)
def _commonest_of(grams_: tuple[str, ...], words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict[bytes, float]]:
    """The commonest entries, read once by a worker from the shared folder; they don't go through the driver."""
    table, named = read_files(grams_).sort_by("pair"), read_files(words)
    known = dict(zip(named.column("word").cast(pa.binary()).to_pylist(), named.column("log").to_pylist(), strict=True))
    return table.column("pair").to_numpy(), table.column("log").to_numpy(), known


def gram_scores(wanted: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gram, log) of the distinct ``gram`` of ``wanted``, from every level of the trie."""
    keys = wanted.select("gram").distinct().select("gram", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("level"))
    keys = keys.select("gram", "level", _low(F.col("gram"), F.col("level") + 1).alias("pair"), _low(F.shiftrightunsigned("gram", 8), F.col("level")).alias("ctx"))
    found = keys.join(pairs.select("level", "pair", "c"), ["level", "pair"], "left").join(nodes, ["level", "ctx"], "left")
    steps = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("level", "c", "total", "followers", "up_total", "up_followers"))).alias("s"))
    top = F.array_max(F.transform(F.filter("s", lambda x: x["total"].isNotNull()), lambda x: x["level"]))
    hit = F.coalesce(F.array_max(F.transform(F.filter("s", lambda x: x["c"].isNotNull()), lambda x: x["level"])), F.lit(-1))
    steps = steps.select("gram", "s", top.alias("top"), hit.alias("hit"))
    at = lambda i: F.get("s", i)
    own = at(F.col("top"))
    room = lambda x: x["up_total"] + x["up_followers"]
    skipped = F.slice("s", F.greatest(F.col("hit") + 3, F.lit(1)), F.greatest(F.col("top") - F.col("hit") - 1, F.lit(0)))
    # A shorter context without followers of its own is passed through for nothing.
    passed = F.aggregate(skipped, F.lit(0.0), lambda acc, x: acc + F.when(room(x) > 0, F.log10(x["up_followers"] / room(x))).otherwise(0.0))
    direct = F.log10(own["c"] / (own["total"] + own["followers"]))
    left = F.log10(own["followers"] / (own["total"] + own["followers"])) + passed
    lower = at(F.col("hit") + 1)
    reached = F.when(F.col("hit") >= 0, F.log10(at(F.col("hit"))["c"] / room(lower))).otherwise(-F.log10(F.greatest(F.lit(SYMBOLS) - at(F.lit(0))["followers"], F.lit(1))))
    log = F.when(F.col("top").isNull(), F.lit(-math.log10(SYMBOLS))).when(F.col("hit") == F.col("top"), direct).otherwise(left + reached)
    return steps.select("gram", log.alias("log"))


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``training`` picks the rows to learn from. Null and empty texts are just their end.
    With nothing to learn from all symbols are equally likely. Repeated rows count and come
    out as often as they occur.
    """
    rows = texts(docs, training.alias("learn"))
    words, gram_counts = count(rows.where("learn"))
    pairs, nodes = trie(gram_counts)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    everything, distinct = int(size[0]), int(size[1])
    whole = math.log10(everything + distinct + 1)
    seen = pairs.where(F.col("level") == ORDER).join(nodes.where(F.col("level") == ORDER).select("ctx", "total", "followers"), "ctx")
    hot = _commonest(pairs.where(F.col("level") == ORDER), "c", HOT_GRAMS).select("pair").join(seen, "pair")
    hot = cut(hot.select("pair", F.log10(F.col("c") / (F.col("total") + F.col("followers"))).alias("log")))
    hot_words = cut(_commonest(words, "n", HOT_WORDS).select("word", F.log10(F.col("n") + 1).alias("log")))
    files = tuple(hot.inputFiles()), tuple(hot_words.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, known = _commonest_of(*files)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            column, ids, learn = batch.column("text"), batch.column("doc_id"), batch.column("learn")
            data, offsets = utf8(column)
            for a, b in slices(offsets):
                n = b - a
                base, n_known, n_tokens = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                rare: list[tuple[int, bytes, int]] = []
                for k, text in enumerate(column.slice(a, n).to_pylist()):
                    found, total = words_of(text), 0.0
                    n_tokens[k] = found.total()
                    for word, times in found.items():
                        log = known.get(word)
                        if log is None:
                            rare.append((row + k, word, times))
                        else:
                            total += times * log
                            n_known[k] += times
                    base[k] = total
                grams_, starts = grams(data, offsets[a : b + 1])
                different, inverse = np.unique(grams_, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, different), max(0, len(keys) - 1))
                there = keys[at] == different if len(keys) else np.zeros(len(different), bool)
                values = np.where(there, logs[at], 0.0) if len(keys) else np.zeros(len(different))
                sums = np.add.reduceat(values[inverse], starts)
                cold = np.flatnonzero(~there[inverse])
                of = np.searchsorted(starts, cold, "right") - 1 + row
                for part in _rows(row, ids.slice(a, n), learn.slice(a, n), n_tokens, n_known, base, sums, rare, of, grams_[cold]):
                    yield part
                row += n

    found = cut(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, word string, gram long, n long, base double, score double"))
    rare = found.where("word is not null").select("row", "word", F.col("n").alias("times")).join(words, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"))
    cold = found.where("gram is not null").select("row", "gram")
    cold = cold.join(gram_scores(cold, pairs, nodes), "gram").groupBy("row").agg(F.sum("log").alias("rest"))
    out = found.where("word is null and gram is null").join(rare, "row", "left").join(cold, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(everything).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + F.coalesce("rest", zero)).alias("score"),
    )


def _rows(row, ids, learn, n_tokens, n_known, base, sums, rare, of, cold) -> Iterator[pa.RecordBatch]:
    """Documents, then words and grams that are not among the commonest."""
    n = len(ids)

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCORES], schema=_SCORES)

    held = [not x for x in learn.to_pylist()]
    yield batch(n, row=np.arange(row, row + n), doc_id=ids, held_out=held, n_tokens=n_tokens, n_known=n_known, base=base, score=sums)
    if rare:
        rows, words, times = zip(*rare, strict=True)
        yield batch(len(rare), row=rows, word=_strings(words), n=times)
    if len(cold):
        yield batch(len(cold), row=of, gram=cold)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir), ~held_out(7, 2))
