"""Source divergence audit (operator 13): how far each source's words stray from its language's.

Terms are counted once, in tasks, and everything after works on counts. What a term adds
depends only on how often its group and its language have it, so terms fall into cells of
(group count, language count): the score is worked out for each cell, cells of equal score
are merged, scores are ranked by the running number of terms in them, and only cells that
reach into the report are expanded to terms, in UTF-8 order. Pairs of sources use the same
idea: in a block of terms, those with equal counts in all sources of a tile are one row with
a multiplicity, and terms that neither source has are one cell, counted by subtraction.

Scores are whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)) and
f = floor((p - q)^2 / q). Products with counts are decimals, so any count is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, drop_cut, read_documents, utf8
from oddsgraph.scale import running_totals

LEAST_DOCUMENTS = 3
REPORTED = 200
MOST_ENTRIES = 300_000
"""Counts that a task holds before it hands them on."""
PIECE = 1 << 20
TERMS_IN_BLOCK = 4096
SOURCES_IN_TILE = 128
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("present", pa.int64())])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size: runs of ASCII letters, lower-cased, and all beyond ASCII."""
    text, at = text.translate(_TERM_BYTES), 0
    while len(text) - at > PIECE and (stop := text.find(b" ", at + PIECE)) >= 0:
        yield text[at:stop].split()
        at = stop
    yield text[at:].split()


class _Counts:
    """Occurrences of terms and documents with them, by group."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, group: tuple[str, str], text: bytes) -> None:
        if group not in self.groups:
            self.groups[group] = Counter(), Counter()
        occurrences, documents = self.groups[group]
        once: set[bytes] = set()
        for found in _terms(text):
            occurrences.update(found)
            once.update(found)
        documents.update(once)

    def entries(self) -> int:
        return sum(len(occurrences) for occurrences, _ in self.groups.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        """One batch a group: a row without a term, then one for each term."""
        for (lang, source), (occurrences, documents) in self.groups.items():
            n = len(occurrences) + 1
            terms = pa.array([None, *occurrences], pa.binary()).cast(pa.string())
            seen = [0, *map(documents.__getitem__, occurrences)]
            columns = [pa.repeat(lang, n), pa.repeat(source, n), terms, pa.array([0, *occurrences.values()], pa.int64()), pa.array(seen, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)
        self.groups = {}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for k, group in enumerate(groups):
            counts.add(group, data[offsets[k] : offsets[k + 1]].tobytes())
            if k % 64 == 63 and counts.entries() > MOST_ENTRIES:
                yield from counts.batches()
    yield from counts.batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it, and for each group a row whose term is null."""
    blank = F.lit("")
    partial = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce("text", blank).alias("text"))
    return (
        partial.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _probability(count: str, total: str) -> Column:
    return F.expr(f"1L + (1000000000BD * ({count} + 1L)) div ({total} + kept)")


def _score(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _term_part(entries: DataFrame, groups: DataFrame) -> DataFrame:
    key = ["lang", "source"]
    cells = (
        entries.groupBy(*key, "n", "lang_n").agg(F.count("*").alias("terms"))
        .join(groups.where("kept > 0"), key)
        .select(*key, "n", "lang_n", "terms", _probability("n", "group_total").alias("p"), _probability("lang_n", "lang_total").alias("q"))
        .where("p > q")
        .select(*key, "n", "lang_n", "terms", _score("p", "q").alias("value"))
    )
    cells = cut(cells)
    values = cells.groupBy(*key, "value").agg(F.sum("terms").alias("terms"), F.negative("value").alias("falling"))
    ranked = running_totals(values, key, "falling", ["terms"]).select(*key, "value", (F.col("cum_terms") - F.col("terms")).alias("before"))
    reached = cells.join(ranked.where(F.col("before") < REPORTED), [*key, "value"]).select(*key, "n", "lang_n", "value", "before")
    place = F.row_number().over(Window.partitionBy(*key, "value").orderBy("term"))
    return (
        entries.join(reached, [*key, "n", "lang_n"])
        .withColumn("place", place).where(F.col("place") <= REPORTED)
        .withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= REPORTED)
        .select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def _compare_tiles(key: tuple, entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Of a block of terms and two tiles of sources: for both orders of each pair the summed score, and the terms counted."""
    tile_a, tile_b = (k.as_py() for k in key[2:])
    names, tiles = sources.column("source").to_pylist(), sources.column("tile").to_numpy()
    places = {name: k for k, name in enumerate(names)}
    terms = entries.column("term").combine_chunks().dictionary_encode()
    count = len(terms.dictionary)
    if not count:
        return PAIRS.empty_table()
    table = np.tile(sources.column("p").to_numpy(), (count, 1))
    owners = np.fromiter(map(places.__getitem__, entries.column("source").to_pylist()), np.int64, entries.num_rows)
    table[terms.indices.to_numpy(), owners] = entries.column("p").to_numpy()
    rows, times = np.unique(table, axis=0, return_counts=True)
    out: tuple[list, list, list] = [], [], []
    for k, name in enumerate(names):
        # Within one tile every other source; between two, those of the other tile.
        other = np.flatnonzero(tiles != tiles[k]) if tile_a != tile_b else np.flatnonzero(np.arange(len(names)) != k)
        apart = rows[:, k : k + 1] - rows[:, other]
        out[0].extend([name] * len(other))
        out[1].extend(names[o] for o in other)
        out[2].extend((times @ (apart * apart // rows[:, other])).tolist())
    n = len(out[0])
    lang = pa.repeat(key[0].as_py(), n)
    return pa.Table.from_arrays([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.repeat(pa.scalar(count, pa.int64()), n)], schema=PAIRS)


def _pair_part(entries: DataFrame, groups: DataFrame) -> DataFrame:
    key = ["lang", "source"]
    width = groups.where("kept > 0").groupBy("lang").agg(
        F.ceil(F.count("*") / SOURCES_IN_TILE).alias("tiles"), F.ceil(F.first("kept") / TERMS_IN_BLOCK).alias("blocks")
    )
    named = groups.where("kept > 0").join(width, "lang").withColumn("tile", F.expr("pmod(xxhash64(source), tiles)"))
    # A tile meets every tile, itself included; the lower number comes first.
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("met")
    group = ["lang", "block", F.least("tile", "met").alias("tile_a"), F.greatest("tile", "met").alias("tile_b")]
    dealt = (
        entries.join(named, key)
        .select("lang", "source", "term", "tile", _probability("n", "group_total").alias("p"), F.expr("pmod(xxhash64(term), blocks)").alias("block"), met)
        .select(*group, "source", "term", "p")
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    sources = (
        named.select(*key, "tile", "tiles", _probability("0L", "group_total").alias("p"), blocks)
        .select("lang", "block", "source", "tile", "p", met)
        .select(*group, "source", "tile", "p")
    )
    at = ["lang", "block", "tile_a", "tile_b"]
    summed = (
        dealt.groupBy(*at).cogroup(sources.groupBy(*at))
        .applyInArrow(_compare_tiles, "lang string, source string, item string, value long, present long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    )
    none = F.when(F.col("kept") > 0, _probability("0L", "group_total"))
    own = groups.select("lang", "source", "kept", none.alias("p"))
    others = groups.select("lang", F.col("source").alias("item"), none.alias("q"))
    absent = (F.col("kept") - F.coalesce("present", F.lit(0))) * _score("p", "q")
    value = F.coalesce(F.coalesce("value", F.lit(0)) + absent, F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item"))
    return (
        own.join(others, "lang").where("source != item")
        .join(summed, [*key, "item"], "left")
        .select(*key, F.lit("pair").alias("part"), "item", value.alias("value"))
        .withColumn("rank", rank)
    )


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how the words of each source differ from others of its language.

    ``docs`` has text, lang and source; no other column is read. Null text, lang or source
    count as empty strings, which name a language and a source like any other. A group is a
    (lang, source) that occurs, with or without terms. A language keeps the V terms found in
    at least three of its rows; repeated rows count each time.

    Part ``pair``: each other source of the language, f summed over all V terms with q the
    other's, 0 if V is 0. Part ``term``: the kept terms that the group has more of than its
    language (p > q), to rank 200. Ranks go by falling value, ties by UTF-8 order; a language
    with one source has no pairs, an empty table no rows.
    """
    counts = cut(term_counts(docs))
    kept = cut(
        counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    )
    entries = cut(counts.drop("docs").join(kept, ["lang", "term"]))
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = cut(
        counts.where("term is null").select("lang", "source")
        .join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
        .fillna(0, ["kept", "lang_total", "group_total"])
    )
    for done in (counts, kept):
        drop_cut(done)
    return _pair_part(entries, groups).unionByName(_term_part(entries, groups))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over all of ``documents``; odd rows as in ``divergence``."""
    return divergence(read_documents(spark, sf_dir))


SQL = r"""
WITH words AS (
  SELECT r, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw
    FROM documents)
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), languages AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), present AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN present USING (lang, source) GROUP BY lang, source
), given AS (
  SELECT t.lang, t.source, k.term, coalesce(p.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(p.n, 0) + 1) // (t.total + l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v)::HUGEINT AS q
  FROM totals t JOIN languages l USING (lang) JOIN kept k USING (lang) LEFT JOIN present p ON p.lang = t.lang AND p.source = t.source AND p.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), reported AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source) AS named
  LEFT JOIN pairs USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM given WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM reported
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
