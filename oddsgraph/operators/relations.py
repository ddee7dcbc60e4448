"""Logical relations between markets, read from question text and event structure.

Edges: (from_condition_id, to_condition_id, type, source, confidence, rationale).
Groups: one row per partition plus a membership table, never an array of members,
so an event of any size stays spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsgraph.functions import text
from oddsgraph.scale import input_bytes, next_row
from oddsgraph.session import cut

SPREAD_BYTES = 64 << 20
"""Texts of less than this a core are dealt over all cores before they are read."""
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
LADDER_KEYS = ["scope", "subject", "direction", "unit", "date_key"]
EDGE_COLUMNS = ["from_condition_id", "to_condition_id", "type", "source", "confidence", "rationale"]


def live_markets(markets: DataFrame) -> DataFrame:
    """Open and present: ``closed`` unknown counts as open."""
    return markets.where(
        (F.coalesce(F.col("closed"), F.lit(False)) == F.lit(False)) & F.col("missing_since").isNull()
    )


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def _identified(markets: DataFrame) -> DataFrame:
    return markets.where(F.col("condition_id").isNotNull() & (F.col("condition_id") != ""))


def _spread(markets: DataFrame) -> DataFrame:
    """Markets ready for their texts to be read, which takes far longer than the scan.

    A table so small that its scan is a task or two is dealt over all cores first; a large
    one has tasks enough and isn't shuffled.
    """
    size, cores = input_bytes(markets), markets.sparkSession.sparkContext.defaultParallelism
    return markets.repartition(cores) if size is not None and size < cores * SPREAD_BYTES else markets


# --- threshold ladders ----------------------------------------------------------------------


def _read_rungs(markets: DataFrame, scope_to_event: bool) -> DataFrame:
    """A row per market with a readable threshold, keyed by its ladder."""
    has_text = "description" in markets.columns
    used = [c for c in ("condition_id", "event_id", "question", "description", "end_date") if c in markets.columns]
    parsed = text.parse_thresholds(_spread(markets.select(*used)), description="description" if has_text else None)
    end = F.date_format("end_date", ISO) if "end_date" in markets.columns else F.lit(None).cast("string")
    stated = F.col("parse.date_text")
    date_key = F.coalesce(F.concat(stated, F.lit("@"), end), stated, end)
    scope = F.coalesce(F.col("event_id"), F.lit("")) if scope_to_event else F.lit("")
    return parsed.where(F.col("parse").isNotNull()).select(
        "condition_id", scope.alias("scope"), date_key.alias("date_key"), "parse.*"
    )


def _usable(rungs: DataFrame) -> DataFrame:
    """Dated rungs. Without a subject only the event tells one market from another."""
    return rungs.where(F.col("date_key").isNotNull() & ((F.col("subject") != "") | (F.col("scope") != "")))


def ladder_rungs(markets: DataFrame, scope_to_event: bool = True) -> DataFrame:
    """One row per market with a readable, dated threshold, keyed by its ladder."""
    return _usable(_read_rungs(_identified(markets), scope_to_event))


def _format_threshold(value: Column, unit: Column) -> Column:
    plain = F.format_string("%s", F.call_function("format_number", value, F.lit("0.################")))
    money = F.concat(F.lit("$"), F.call_function("format_number", value, F.lit("#,##0.###")))
    return (
        F.when(unit == "usd", money)
        .when(unit == "percent", F.concat(plain, F.lit("%")))
        .when(unit == "bps", F.concat(plain, F.lit("bps")))
        .when(unit == "temperature", F.concat(plain, F.lit("°")))
        .otherwise(plain)
    )


def ladder_edges(rungs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Implications between neighbouring thresholds of each ladder.

    Equal thresholds are one point: its smallest id meets the rung below, its
    largest the rung above (rows ordered by threshold, then id). Only neighbours
    are linked; reachability supplies the rest.
    """
    points = rungs.groupBy(*LADDER_KEYS, "threshold").agg(
        F.min("condition_id").alias("lo"), F.max("condition_id").alias("hi")
    )
    steps = next_row(points, LADDER_KEYS, "threshold", ["threshold", "lo"], buckets=buckets)
    steps = steps.where(F.col("next_lo").isNotNull() & (F.col("next_lo") != F.col("hi")))
    rising = F.col("direction") == "gt"
    sign = F.when(rising, ">").otherwise("<")
    strong = _format_threshold(F.when(rising, F.col("next_threshold")).otherwise(F.col("threshold")), F.col("unit"))
    weak = _format_threshold(F.when(rising, F.col("threshold")).otherwise(F.col("next_threshold")), F.col("unit"))
    claim = F.format_string(
        'Threshold ladder "%s" (%s): %s %s implies %s %s.',
        F.col("subject"), F.col("date_key"), sign, strong, sign, weak,
    )
    return steps.select(
        F.when(rising, F.col("next_lo")).otherwise(F.col("hi")).alias("from_condition_id"),
        F.when(rising, F.col("hi")).otherwise(F.col("next_lo")).alias("to_condition_id"),
        F.lit("implies").alias("type"),
        F.lit("ladder").alias("source"),
        F.lit(1.0).alias("confidence"),
        claim.alias("rationale"),
    )


def ladder_stats(markets: DataFrame, scope_to_event: bool = True, buckets: int | None = None) -> DataFrame:
    """considered, parsed, in_ladders, ladders, edges — one row. The texts are read once."""
    considered = markets.agg(F.count("*").alias("considered"))
    every = cut(_read_rungs(markets, scope_to_event))
    parsed = every.agg(F.count("*").alias("parsed"))
    rungs = _usable(_identified(every))
    sizes = rungs.groupBy(*LADDER_KEYS).agg(F.count("*").alias("size")).where(F.col("size") >= 2)
    in_ladders = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("in_ladders"), F.count("*").alias("ladders")
    )
    edges = ladder_edges(rungs, buckets).agg(F.count("*").alias("edges"))
    return one_row(considered, parsed, in_ladders, edges)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side; each part is exactly one row."""
    out = parts[0].withColumn("__one", F.lit(1))
    for part in parts[1:]:
        out = out.join(F.broadcast(part.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


# --- deadlines ------------------------------------------------------------------------------


def deadline_rungs(markets: DataFrame, negation_guard: bool = False) -> DataFrame:
    """Markets that ask for something by a date. With the guard, negated ones are left out:
    "not by June" does not imply "not by December"."""
    parsed = text.parse_deadlines(_spread(_identified(markets).select("condition_id", "question", "end_date"))).where(
        F.col("deadline").isNotNull() & F.col("end_date").isNotNull()
    )
    if negation_guard:
        negated = F.lit(False)
        for pattern, _ in text.NEGATIONS:
            negated = negated | text.normalise_question(F.col("question")).rlike(pattern)
        parsed = parsed.where(~negated)
    return parsed.select("condition_id", "end_date", "deadline.subject", "deadline.deadline_text")


def deadline_edges(rungs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Earlier deadline implies the next later one, per identical subject."""
    who = F.struct("condition_id", "deadline_text")
    points = rungs.groupBy("subject", "end_date").agg(F.min(who).alias("lo"), F.max(who).alias("hi"))
    steps = next_row(points, ["subject"], "end_date", ["lo"], buckets=buckets)
    steps = steps.where(
        F.col("next_lo").isNotNull() & (F.col("next_lo.condition_id") != F.col("hi.condition_id"))
    )
    claim = F.format_string(
        'Nested deadlines on "%s": by %s implies by %s.',
        F.col("subject"), F.col("hi.deadline_text"), F.col("next_lo.deadline_text"),
    )
    return steps.select(
        F.col("hi.condition_id").alias("from_condition_id"),
        F.col("next_lo.condition_id").alias("to_condition_id"),
        F.lit("implies").alias("type"),
        F.lit("temporal").alias("source"),
        F.lit(1.0).alias("confidence"),
        claim.alias("rationale"),
    )


# --- complements ----------------------------------------------------------------------------


def complement_edges(markets: DataFrame, scope_to_event: bool = True) -> DataFrame:
    """Pairs whose questions differ by exactly one deleted negation, matched one to one."""
    base = _identified(markets).where(F.col("question").isNotNull())
    scope = F.coalesce(F.col("event_id"), F.lit("")) if scope_to_event else F.lit("")
    base = _spread(base).select(
        "condition_id", "question", scope.alias("scope"),
        text.normalise_question(F.col("question")).alias("form"),
    )
    if scope_to_event:
        base = base.where(F.col("scope") != "")
    positives = (
        base.groupBy("scope", "form")
        .agg(F.count("*").alias("n"), F.min("condition_id").alias("pos_id"), F.min("question").alias("pos_q"))
        .where("n = 1")
        .drop("n")
    )
    negatives = base.select(
        F.col("condition_id").alias("neg_id"),
        F.col("question").alias("neg_q"),
        "scope",
        F.explode(text.positive_forms(F.col("form"))).alias("form"),
    )
    pairs = negatives.join(positives, ["scope", "form"]).where("neg_id <> pos_id")
    low, high = canonical_pair(F.col("neg_id"), F.col("pos_id"))
    claim = F.format_string('"%s" denies "%s": exactly one holds.', F.col("neg_q"), F.col("pos_q"))
    found = pairs.groupBy(low.alias("from_condition_id"), high.alias("to_condition_id")).agg(
        F.count("*").alias("claims"), F.min(claim).alias("rationale")
    )
    return found.where("claims = 1").select(
        "from_condition_id",
        "to_condition_id",
        F.lit("complement").alias("type"),
        F.lit("complement").alias("source"),
        F.lit(1.0).alias("confidence"),
        "rationale",
    )


# --- partitions -----------------------------------------------------------------------------


@dataclass
class Partitions:
    groups: DataFrame  # group_id, type, source, confidence, members, rationale
    members: DataFrame  # group_id, condition_id


def yes_no(outcomes: Column) -> Column:
    """Exactly the two outcomes Yes and No, in that order."""
    label = F.transform(outcomes, lambda o: F.lower(F.trim(o)))
    return F.coalesce(label == F.array(F.lit("yes"), F.lit("no")), F.lit(False))


def partitions(markets: DataFrame, events: DataFrame, min_members: int = 2) -> Partitions:
    """One mutually exclusive and exhaustive group per event the venue flags so."""
    flagged = events.where(F.col("neg_risk") & (F.col("id") != "")).groupBy("id").agg(
        F.max("title").alias("title")
    )
    candidates = (
        _identified(markets)
        .where(yes_no(F.col("outcomes")))
        .select(F.col("event_id").alias("id"), "condition_id")
        .join(flagged, "id", "left_semi")
        .distinct()
    )
    sized = candidates.groupBy("id").agg(F.count("*").alias("members"))
    sized = sized.where(F.col("members") >= min_members).join(flagged, "id")
    key = F.concat(F.lit("partition:neg-risk-event:"), F.col("id"))
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("id"))
    groups = sized.select(
        key.alias("group_id"),
        F.lit("partition").alias("type"),
        F.lit("neg-risk-event").alias("source"),
        F.lit(1.0).alias("confidence"),
        "members",
        F.format_string('Exactly one of the %d markets of "%s" resolves Yes.', F.col("members"), name).alias(
            "rationale"
        ),
    )
    members = candidates.join(sized, "id", "left_semi").select(key.alias("group_id"), "condition_id")
    return Partitions(groups, members)


def partition_conflicts(groups: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between members of one partition that the partition rules out.

    Two equi-joins from the edge side; pairs of members are never formed.
    """
    source = members.select(F.col("group_id"), F.col("condition_id").alias("from_condition_id"))
    target = members.select(F.col("group_id"), F.col("condition_id").alias("to_condition_id"))
    inside = (
        edges.select("from_condition_id", "to_condition_id", "type", "source")
        .join(source, "from_condition_id")
        .join(target, ["group_id", "to_condition_id"], "left_semi")
        .join(groups.select("group_id", "members"), "group_id")
    )
    bad = (F.col("type") == "implies") | ((F.col("type") == "complement") & (F.col("members") != 2))
    detail = F.when(
        F.col("type") == "implies", F.lit("implication inside a mutually exclusive partition")
    ).otherwise(F.concat(F.lit("complement inside a partition of "), F.col("members").cast("string")))
    return inside.where(bad).select(
        F.col("group_id").alias("partition_key"), "from_condition_id", "to_condition_id", "source",
        detail.alias("detail"),
    )


# --- everything -----------------------------------------------------------------------------


@dataclass
class Extraction:
    edges: DataFrame  # EDGE_COLUMNS plus conflict
    groups: DataFrame
    members: DataFrame
    conflicts: DataFrame

    def consistent_edges(self) -> DataFrame:
        return self.edges.where(~F.col("conflict")).drop("conflict")

    def stats(self) -> DataFrame:
        e = self.edges.agg(
            F.count_if(F.col("source") == "ladder").alias("ladder_edges"),
            F.count_if(F.col("source") == "temporal").alias("temporal_edges"),
            F.count_if(F.col("source") == "complement").alias("complement_edges"),
        )
        g = self.groups.agg(
            F.count("*").alias("partitions"),
            F.coalesce(F.sum("members"), F.lit(0)).alias("partition_members"),
        )
        return one_row(e, g, self.conflicts.agg(F.count("*").alias("conflicts")))


def extract_relations(
    markets: DataFrame, events: DataFrame, negation_guard: bool = False, buckets: int | None = None
) -> Extraction:
    """All extractors over one catalog. Conflicting edges are kept and flagged.

    The edges are written once: conflicts, flags and whatever the caller counts read them
    without reading a question again.
    """
    edges = cut(
        ladder_edges(ladder_rungs(markets), buckets)
        .unionByName(deadline_edges(deadline_rungs(markets, negation_guard), buckets))
        .unionByName(complement_edges(markets))
    )
    parts = partitions(markets, events)
    conflicts = partition_conflicts(parts.groups, parts.members, edges)
    bad = conflicts.select("from_condition_id", "to_condition_id").distinct().withColumn("__bad", F.lit(True))
    flagged = edges.join(bad, ["from_condition_id", "to_condition_id"], "left").select(
        *EDGE_COLUMNS, F.coalesce("__bad", F.lit(False)).alias("conflict")
    )
    return Extraction(flagged, parts.groups, parts.members, conflicts)


# --- stored relations -----------------------------------------------------------------------


def relation_id() -> Column:
    """Stable id of a relation: the same edge has the same id in every run."""
    return F.sha2(F.concat_ws("|", "from_condition_id", "to_condition_id", "type"), 256)


def save_edges(stored: DataFrame, incoming: DataFrame, now: Column, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert edges on (from, to, type): (merged table, one row of counts).

    Self-edges and repeats are rejected; the first by ``arrival`` wins. Known edges
    keep ``first_seen_at`` and take the new source, confidence and rationale.
    """
    key = ["from_condition_id", "to_condition_id", "type"]
    fields = F.struct("source", "confidence", "rationale")
    order = F.col(arrival) if arrival else fields
    clean = (
        incoming.where("from_condition_id <> to_condition_id")
        .groupBy(*key)
        .agg(F.min_by(fields, order).alias("new"))
    )
    old = stored.withColumn("__old", F.lit(True))
    both = old.join(clean, key, "full_outer")
    fresh = F.col("new").isNotNull()
    known = F.coalesce("__old", F.lit(False))
    merged = both.select(
        F.coalesce("id", relation_id()).alias("id"),
        *key,
        *[F.when(fresh, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in ("source", "confidence", "rationale")],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(fresh, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    counts = both.agg(
        F.count_if(fresh & ~known).alias("inserted"), F.count_if(fresh & known).alias("refreshed")
    )
    counts = one_row(incoming.agg(F.count("*").alias("submitted")), counts)
    counts = counts.withColumn("rejected", F.col("submitted") - F.col("inserted") - F.col("refreshed"))
    return merged, counts


def save_groups(
    stored: DataFrame, stored_members: DataFrame, groups: DataFrame, members: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Upsert groups by id; membership of touched groups is replaced as a whole."""
    cols = ["type", "source", "confidence", "rationale"]
    fields = F.struct(*cols)
    clean = groups.groupBy("group_id").agg(F.min(fields).alias("new"))
    both = stored.join(clean, "group_id", "full_outer")
    fresh = F.col("new").isNotNull()
    merged = both.select(
        "group_id",
        *[F.when(fresh, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in cols],
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(fresh, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    kept = stored_members.join(clean, "group_id", "left_anti").select("group_id", "condition_id")
    new = members.join(clean, "group_id", "left_semi").select("group_id", "condition_id").distinct()
    return merged, kept.unionByName(new)


def relations_from(edges: DataFrame, condition_id: str) -> DataFrame:
    return edges.where(F.col("from_condition_id") == condition_id).orderBy("to_condition_id")


# --- bands ----------------------------------------------------------------------------------

BLOCK = 500
"""Bands with one interval that meet others as one row, about."""


def band_markets(markets: DataFrame) -> DataFrame:
    """Markets asking for a value inside an interval, with the interval."""
    banded = text.parse_bands(_identified(markets))
    return banded.where(F.col("band").isNotNull())


def exclusive_neighbours(markets: DataFrame, buckets: int | None = None) -> DataFrame:
    """Neighbouring intervals of one subject, date and event that cannot both hold."""
    bands = band_markets(markets).select(
        "condition_id", F.coalesce("event_id", F.lit("")).alias("scope"), "band.*"
    )
    keys = ["scope", "prefix", "suffix"]
    points = bands.groupBy(*keys, "low").agg(
        F.min(F.struct("condition_id", "high")).alias("first"), F.max(F.struct("condition_id", "high")).alias("last")
    )
    steps = next_row(points, keys, "low", ["low", "first"], buckets=buckets)
    return steps.where(F.col("last.high") <= F.col("next_low")).select(
        *keys,
        F.col("last.condition_id").alias("a_condition_id"),
        F.col("next_first.condition_id").alias("b_condition_id"),
    )


def overlapping_bands(markets: DataFrame) -> DataFrame:
    """(scope, prefix, suffix, a_condition_id, b_condition_id): bands of one family that can both hold.

    Bands with one interval stand together in blocks of about ``BLOCK`` ids, which meet in an
    interval join by cells. The value line of a family is cut into cells as wide as its
    bands are on average, so all bands together cover about two cells each, however wide one
    is. A block stands in every cell it covers and meets the blocks that start in that cell:
    a pair is found once, where the later one starts (of equal starts the larger id), and bands
    far apart never meet. Pairs of blocks are dealt over all tasks before they are expanded.
    """
    keys = ["scope", "prefix", "suffix"]
    # Read once: the questions' patterns cost more than all that follows but the pairs.
    bands = cut(band_markets(_spread(markets)).select("condition_id", F.coalesce("event_id", F.lit("")).alias("scope"), "band.*"))
    same = [*keys, "low", "high"]
    width = bands.groupBy(*keys).agg(F.min("low").alias("origin"), F.avg(F.col("high") - F.col("low")).alias("width"))
    size = bands.groupBy(*same).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = bands.join(size, same).groupBy(*same, F.pmod(F.xxhash64("condition_id"), "parts").alias("part")).agg(F.collect_list("condition_id").alias("ids"))
    placed = blocks.join(width, keys).withColumn("home", F.floor((F.col("low") - F.col("origin")) / F.col("width")))
    last = F.floor((F.col("high") - F.col("origin")) / F.col("width"))
    cover = F.explode(F.sequence("home", F.greatest("home", last))).alias("cell")
    earlier = placed.select(*keys, cover, F.col("ids").alias("a_ids"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    later = placed.select(*keys, F.col("home").alias("cell"), F.col("ids").alias("b_ids"), F.col("low").alias("b_low"))
    met = earlier.join(later, [*keys, "cell"]).where((F.col("a_low") <= F.col("b_low")) & (F.col("b_low") < F.col("a_high")))
    met = met.select(*keys, "a_ids", "b_ids", (F.col("a_low") < F.col("b_low")).alias("sure"))
    met = met.repartition(4 * int(markets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.withColumn("a_condition_id", F.explode("a_ids")).withColumn("b_condition_id", F.explode("b_ids"))
    return pairs.where(F.col("sure") | (F.col("a_condition_id") < F.col("b_condition_id"))).select(*keys, "a_condition_id", "b_condition_id")


def verify_exclusive(pairs: DataFrame, markets: DataFrame, parts: int | None = None) -> DataFrame:
    """``pairs`` (a_condition_id, b_condition_id, ...) with ``finding``: what the questions say of a proposed exclusion.

    exclusive: bands of one subject and date that cannot both hold; overlapping: bands of one
    subject and date that can; unrelated: bands of different ones; unproven: a question
    without a band, or a market that isn't there. ``pairs`` that are dealt by a_condition_id
    over ``parts`` partitions are dealt by b_condition_id over as many, so that a task's share
    stays the same however many pairs there are.
    """
    bands = band_markets(markets).select("condition_id", F.coalesce("event_id", F.lit("")).alias("scope"), "band")
    a = bands.select(F.col("condition_id").alias("a_condition_id"), F.struct("scope", "band").alias("__a"))
    b = bands.select(F.col("condition_id").alias("b_condition_id"), F.struct("scope", "band").alias("__b"))
    both = pairs.join(a, "a_condition_id", "left")
    both = (both.repartition(parts, "b_condition_id") if parts else both).join(b, "b_condition_id", "left")
    one, two = F.col("__a"), F.col("__b")
    family = (one["scope"] == two["scope"]) & (one["band"]["prefix"] == two["band"]["prefix"]) & (one["band"]["suffix"] == two["band"]["suffix"])
    finding = (
        F.when(one.isNull() | two.isNull(), "unproven").when(~family, "unrelated")
        .when(text.bands_disjoint(one["band"], two["band"]), "exclusive").otherwise("overlapping")
    )
    return both.select(*pairs.columns, finding.alias("finding"))
