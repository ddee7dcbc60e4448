"""Order MinHash fingerprints: alike if texts are close in edit distance, not only in content.

Tokens are runs of up to twelve visible characters, k-mers are two tokens in a row, and
repeats of a k-mer are told apart by their occurrence number. One hash of each numbered
k-mer deals it into one of 64 bins and ranks it there, so that every bin works as a
permutation of its own. Of each bin the two smallest k-mers are put back into text order
and hashed as a tuple: moving text about changes tuples even where all k-mers stay.

Everything is column expressions inside one row; texts move once, to meet their neighbour.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, let, read_documents, texts

BIN_BITS = 6
TUPLE = 2
_PLACE_BITS = 28
_PLACE = (1 << _PLACE_BITS) - 1


def _tagged(hash_: Column, place: Column) -> Column:
    """The upper 36 bits of a hash over a place in the text: sorts by hash, then place."""
    return hash_.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def _place(tagged: Column) -> Column:
    return tagged.bitwiseAND(F.lit(_PLACE)).cast("int")


def _hash(tagged: Column) -> Column:
    return F.shiftright(tagged, _PLACE_BITS)


def _bin(tagged: Column) -> Column:
    return F.shiftrightunsigned(tagged, 64 - BIN_BITS)


def _kmers(text: Column) -> Column:
    def pairs(t: Column) -> Column:
        n = F.size(t)
        two = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1)))
        one = F.transform(t, lambda x: F.xxhash64(x))
        return F.when(n >= 2, two).otherwise(one)

    return let(F.regexp_extract_all(text, F.lit(r"\S{1,12}"), F.lit(0)), pairs)


def _numbered(kmers: Column, order: Column) -> Column:
    """Tagged hashes of (k-mer, occurrence number), from the k-mers' own tags in order."""
    n = F.size(order)
    new = lambda i: (i == 0) | (_hash(F.get(order, i)) != _hash(F.get(order, i - 1)))

    def with_runs(starts: Column) -> Column:
        counted = F.flatten(F.transform(starts, lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), n) - s - 1)))
        single = F.transform(order, lambda x: _tagged(F.xxhash64(F.get(kmers, _place(x)), F.lit(0)), _place(x)))
        repeated = let(counted, lambda c: F.transform(order, lambda x, i: _tagged(F.xxhash64(F.get(kmers, _place(x)), F.get(c, i)), _place(x))))
        return F.when(F.size(starts) == n, single).otherwise(repeated)

    return let(F.filter(F.sequence(F.lit(0), n - 1), new), with_runs)


def _tuples(kmers: Column, ranked: Column) -> Column:
    """One number for each bin that has k-mers: bin, then 32 bits of the hash of its tuple."""
    same = lambda a, b: _bin(a) == _bin(b)
    least = F.filter(ranked, lambda x, i: (i < TUPLE) | ~same(F.get(ranked, i - TUPLE), x))

    def entries(c: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | ~same(F.get(c, i - 1), F.get(c, i)))

        def entry(i: Column) -> Column:
            mine, after = F.get(c, i), F.get(c, i + 1)
            a, b = _place(mine), _place(after)
            both = F.xxhash64(F.get(kmers, F.least(a, b)), F.get(kmers, F.greatest(a, b)))
            value = F.when(F.coalesce(same(mine, after), F.lit(False)), both).otherwise(F.xxhash64(F.get(kmers, a)))
            return F.shiftleft(_bin(mine), 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))

        return F.sort_array(F.transform(first, entry))

    return let(least, entries)


def order_minhash(text: Column) -> Column:
    """The fingerprint as sorted numbers, at most one for each bin; none for a text without tokens."""

    def whole(kmers: Column) -> Column:
        order = F.sort_array(F.transform(kmers, lambda h, i: _tagged(h, i)))
        ranked = let(order, lambda o: F.sort_array(_numbered(kmers, o)))
        some = let(ranked, lambda r: _tuples(kmers, r))
        return F.when(F.size(kmers) > 0, some).otherwise(F.array().cast("array<bigint>"))

    return let(_kmers(text), whole)


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples among the bins that either fingerprint fills; 1 for two empty ones."""
    bins = lambda f: F.transform(f, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(fingerprint: Column) -> Column:
    """Ten hexadecimal digits for each bin in use: two for the bin, eight for its tuple."""
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): the next document in descending doc_id, after the last the first.

    Null doc_ids come after all others, rows of one doc_id are ordered by their text's hash.
    doc_id is cut into ranges of about equal numbers of rows, one for each shuffle
    partition; a range ends with a copy of the next one's first document, so no range
    needs another.
    """
    base = texts(docs)
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = base.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    splits = [float("-inf"), *sorted(set(limits) or {0.0}), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        out = cutter.transform(df.withColumn("__x", F.col("doc_id").cast("double")))
        # Falling doc_ids, so later ranges come first; nulls, which get a range of their own above, come last.
        return out.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(len(splits) - 1 - F.col("__b").cast("int"))).drop("__x", "__b")

    tops = cut(ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"))).groupBy("range").agg(F.max("doc_id").alias("top")))
    mine = ranged(base).withColumn("h", F.xxhash64("text"))
    # At most one row for each range.
    first = mine.join(F.broadcast(tops.withColumnRenamed("range", "r")), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("range") == F.col("r")))
    first = first.groupBy("range").agg(F.min_by("text", "h").alias("text"))
    turn = tops.select("range", F.lag("range").over(Window.orderBy("range")).alias("before"), F.max("range").over(Window.orderBy(F.lit(1))).alias("end"))
    copies = first.join(turn, "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("before", "end").alias("range"), F.lit(None).cast("long").alias("h"), F.lit(1).alias("copy"))
    both = mine.withColumn("copy", F.lit(0)).select("doc_id", "text", "range", "h", "copy").unionByName(copies)
    marked = both.withColumn("fp", order_minhash(F.col("text")))
    window = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "h")
    after = F.lead(F.struct("text", "fp")).over(window).alias("after")
    rows = marked.select("doc_id", "text", "fp", "copy", after).where("copy = 0")
    return rows.select("doc_id", "text", "fp", F.col("after.text").alias("next_text"), F.col("after.fp").alias("next_fp"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substr(text, 1, n_chars - n_chars div 3), substr(next_text, 1, n_chars div 3))")
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_fp", order_minhash(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
