"""Proposed relations: validating answers, storing, reviewing and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsgraph.functions import text
from oddsgraph.functions.coerce import get, kind
from oddsgraph.operators.relations import canonical_pair, relation_id
from oddsgraph.scale import running_totals, top

# --- fixed values -------------------------------------------------------------
PROPOSED_TYPES = ["implies", "implied_by", "complement", "mutually_exclusive", "unrelated"]
MAX_RATIONALE = 600
VERDICTS = {"a": "accepted", "r": "rejected", "s": "skipped"}
REVIEWED_SOURCE = "llm_reviewed"
# ------------------------------------------------------------------------------

PAIR = ["low_condition_id", "high_condition_id"]


def json_of_answer(answer: Column) -> Column:
    """The outermost braces of a fenced or plain answer, as text; null when there are none."""
    fenced = F.regexp_extract(answer, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(answer.rlike(r"(?is)```(?:json)?\s*.*?```"), F.trim(fenced)).otherwise(F.trim(answer))
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def validate_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Add ``relation``, ``rationale``, ``confidence`` and ``valid``.

    Strict: exactly the three keys, a known relation, 1–600 characters of rationale,
    a numeric confidence in [0, 1].
    """
    doc = F.col("__doc")
    keys = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    relation = F.try_variant_get(doc, "$.relation", "string")
    rationale = F.trim(F.try_variant_get(doc, "$.rationale", "string"))
    confidence = F.try_variant_get(doc, "$.confidence", "double")
    numeric = kind(get(doc, "$.confidence")).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    ok = (
        (F.array_sort(keys) == F.array(F.lit("confidence"), F.lit("rationale"), F.lit("relation")))
        & relation.isin(PROPOSED_TYPES)
        & (kind(get(doc, "$.rationale")) == "STRING")
        & F.length(rationale).between(1, MAX_RATIONALE)
        & numeric & confidence.between(0.0, 1.0)
    )
    out = answers.select("*", F.explode(F.array(F.try_parse_json(json_of_answer(F.col(column))))).alias("__doc"))
    out = out.withColumn("valid", F.coalesce(ok, F.lit(False)))
    v = F.col("valid")
    return out.select(
        *answers.columns,
        F.when(v, relation).alias("relation"), F.when(v, rationale).alias("rationale"),
        F.when(v, confidence).alias("confidence"), "valid",
    )


def canonical_proposals(proposals: DataFrame, arrival: str) -> DataFrame:
    """Pairs in id order with direction turned to match; the last of a pair wins."""
    low, high = canonical_pair(F.col("a_condition_id"), F.col("b_condition_id"))
    turned = F.col("a_condition_id") > F.col("b_condition_id")
    relation = (
        F.when(turned & (F.col("relation") == "implies"), "implied_by")
        .when(turned & (F.col("relation") == "implied_by"), "implies")
        .otherwise(F.col("relation"))
    )
    fields = F.struct(
        relation.alias("proposed_type"), "rationale", F.col("confidence").alias("model_confidence"), "model", "similarity"
    )
    return (
        proposals.where("a_condition_id <> b_condition_id")
        .groupBy(low.alias(PAIR[0]), high.alias(PAIR[1]))
        .agg(F.max_by(fields, F.col(arrival)).alias("p"))
        .select(*PAIR, "p.*")
    )


def proposal_id() -> Column:
    return F.sha2(F.concat_ws("|", *PAIR), 256)


def save_proposals(stored: DataFrame, proposals: DataFrame, arrival: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append as pending, counts). A pair already stored is never touched."""
    clean = canonical_proposals(proposals, arrival)
    fresh = clean.join(stored.select(*PAIR), PAIR, "left_anti").select(
        proposal_id().alias("id"), *clean.columns, F.lit("pending").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("reviewed_by", "review_note")],
    )
    counts = clean.join(stored.select(*PAIR, F.lit(1).alias("known")), PAIR, "left").agg(
        F.count_if(F.col("known").isNull()).alias("inserted"), F.count("known").alias("duplicate")
    )
    return fresh, counts


def pending_proposals(stored: DataFrame, markets: DataFrame, limit: int | None = None, include_unrelated: bool = False) -> DataFrame:
    """The review queue with both questions; with a limit the most confident."""
    wanted = stored.where("status = 'pending'")
    if not include_unrelated:
        wanted = wanted.where("proposed_type <> 'unrelated'")
    low = markets.select(F.col("condition_id").alias(PAIR[0]), F.col("question").alias("low_question"))
    high = markets.select(F.col("condition_id").alias(PAIR[1]), F.col("question").alias("high_question"))
    return top(wanted.join(low, PAIR[0]).join(high, PAIR[1]), limit, F.desc("model_confidence"), "id")


def proposal_edges(proposals: DataFrame) -> DataFrame:
    """Edges of accepted proposals; exclusivity and 'unrelated' give none."""
    t = F.col("proposed_type")
    rows = proposals.where(t.isin("implies", "implied_by", "complement"))
    back = t == "implied_by"
    return rows.select(
        F.when(back, F.col(PAIR[1])).otherwise(F.col(PAIR[0])).alias("from_condition_id"),
        F.when(back, F.col(PAIR[0])).otherwise(F.col(PAIR[1])).alias("to_condition_id"),
        F.when(t == "complement", "complement").otherwise("implies").alias("type"),
        F.lit(REVIEWED_SOURCE).alias("source"),
        F.lit(1.0).alias("confidence"),
        F.concat(F.lit("Reviewed and accepted ("), "model", F.lit("): "), "rationale").alias("rationale"),
    )


def parse_verdicts(lines: DataFrame) -> DataFrame:
    """Lines ``<id> <a|r|s> [note]`` to (proposal_id, status, note, malformed, line); # starts a comment.

    ``lines`` has value and, to order repeated verdicts, line.
    """
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s+", 3)
    verdict = F.lower(F.try_element_at(parts, F.lit(2)))
    words = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    status = F.try_element_at(words, verdict)
    note = F.trim(F.try_element_at(parts, F.lit(3)))
    return lines.where((line != "") & ~line.startswith("#")).select(
        F.element_at(parts, 1).alias("proposal_id"), status.alias("status"),
        F.when(note != "", note).alias("note"), status.isNull().alias("malformed"),
        (F.col("line") if "line" in lines.columns else F.lit(0)).alias("line"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts in order of file, block and line."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return parse_verdicts(lines.select("value", F.struct("file_path", "file_block_start", "n").alias("line")))


def apply_verdicts(stored: DataFrame, verdicts: DataFrame, reviewer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals′, accepted edges with ids, counts). Only pending rows change.

    Of several verdicts on a proposal the first line counts; the others come too late.
    """
    usable = verdicts.where(~F.col("malformed")).groupBy("proposal_id").agg(
        F.min_by(F.struct("status", "note"), F.struct("line", "status", "note")).alias("v"), F.count("*").alias("verdicts")
    )
    both = stored.join(usable, F.col("id") == F.col("proposal_id"), "left")
    hit = F.col("v").isNotNull() & (F.col("status") == "pending")
    both = both.withColumn("__hit", hit)
    after = both.select(
        *[
            F.when(F.col("__hit"), new).otherwise(F.col(c)).alias(c) if new is not None else F.col(c)
            for c in stored.columns
            for new in [
                {"status": F.col("v.status"), "reviewed_by": F.lit(reviewer), "review_note": F.col("v.note")}.get(c)
            ]
        ]
    )
    accepted = both.where(F.col("__hit") & (F.col("v.status") == "accepted"))
    edges = proposal_edges(accepted).withColumn("id", relation_id())
    counts = both.agg(
        F.count_if("__hit").alias("applied"),
        F.coalesce(F.sum(F.col("verdicts") - F.col("__hit").cast("int")), F.lit(0)).alias("already_decided"),
        F.count_if(
            F.col("__hit") & (F.col("v.status") == "accepted")
            & F.col("proposed_type").isin("implies", "implied_by", "complement")
        ).alias("edges_written"),
    )
    return after, edges, counts


def review_precision(stored: DataFrame) -> DataFrame:
    """accepted / (accepted + rejected), overall (proposed_type 'all') and by type."""
    per = stored.groupBy("proposed_type").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "skipped", "pending")]
    )
    total = per.agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "skipped", "pending")])
    out = total.select(F.lit("all").alias("proposed_type"), "*").unionByName(per)
    decided = F.col("accepted") + F.col("rejected")
    return out.withColumn("precision", F.when(decided > 0, F.col("accepted") / decided))


# --- labelled sets --------------------------------------------------------------------------


def entailment_set(relations: DataFrame, markets: DataFrame, count: int) -> DataFrame:
    """Known implications in hash order, every second one turned round."""
    q = markets.where(F.col("question").isNotNull()).select("condition_id")
    known = relations.where(F.col("source").isin("ladder", "temporal") & (F.col("type") == "implies"))
    known = known.join(q.withColumnRenamed("condition_id", "from_condition_id"), "from_condition_id", "left_semi")
    known = known.join(q.withColumnRenamed("condition_id", "to_condition_id"), "to_condition_id", "left_semi")
    digest = F.md5(F.concat("from_condition_id", "to_condition_id"))
    sample = known.select("from_condition_id", "to_condition_id", digest.alias("h")).orderBy("h", "from_condition_id").limit(count)
    # ``count`` rows at most reach this window.
    numbered = sample.withColumn("i", F.row_number().over(Window.orderBy("h", "from_condition_id")))
    forward = F.col("i") % 2 == 1
    return numbered.select(
        F.when(forward, F.col("from_condition_id")).otherwise(F.col("to_condition_id")).alias("a_condition_id"),
        F.when(forward, F.col("to_condition_id")).otherwise(F.col("from_condition_id")).alias("b_condition_id"),
        F.when(forward, "implies").otherwise("implied_by").alias("truth"), F.lit("entailment").alias("family"),
    )


def band_set(markets: DataFrame, count: int | None = None, buckets: int | None = None) -> DataFrame:
    """Disjoint neighbours (1st–2nd, 3rd–4th …) of each interval family, in hash order."""
    live = markets.where(F.col("missing_since").isNull()) if "missing_since" in markets.columns else markets
    bands = text.parse_bands(live).where(F.col("band").isNotNull()).select(
        F.coalesce("event_id", F.lit("")).alias("scope"), "condition_id", "band.*", F.lit(1).alias("one")
    )
    keys = ["scope", "prefix", "suffix"]
    numbered = running_totals(bands, keys, "low", ["one"], "n_", buckets=buckets, tie=["condition_id"])
    slot = F.floor((F.col("n_one") - 1) / 2)
    item = F.struct("low", "condition_id", "high")
    pairs = numbered.groupBy(*keys, slot.alias("slot")).agg(F.min(item).alias("a"), F.max(item).alias("b"), F.count("*").alias("n"))
    good = pairs.where((F.col("n") == 2) & (F.col("a.high") <= F.col("b.low"))).select(
        F.col("a.condition_id").alias("a_condition_id"), F.col("b.condition_id").alias("b_condition_id"),
        F.lit("mutually_exclusive").alias("truth"), F.lit("bands").alias("family"),
    )
    if count is None:
        return good
    return good.orderBy(F.md5(F.concat("a_condition_id", "b_condition_id"))).limit(count)


def cross_event_set(markets: DataFrame, count: int) -> DataFrame:
    """One market per event, paired off in hash order: pairs with nothing in common."""
    ok = (F.col("question") != "") & F.col("event_id").isNotNull()
    if "missing_since" in markets.columns:
        ok = ok & F.col("missing_since").isNull()
    one = markets.where(ok).groupBy("event_id").agg(F.min("condition_id").alias("condition_id"))
    sample = one.select("condition_id", F.md5("condition_id").alias("h")).orderBy("h").limit(2 * count)
    numbered = sample.withColumn("i", F.row_number().over(Window.orderBy("h")))
    pairs = numbered.groupBy(F.floor((F.col("i") - 1) / 2).alias("slot")).agg(
        F.min_by("condition_id", "i").alias("a_condition_id"), F.max_by("condition_id", "i").alias("b_condition_id"),
        F.count("*").alias("n"),
    )
    return pairs.where("n = 2").select(
        "a_condition_id", "b_condition_id", F.lit("unrelated").alias("truth"), F.lit("cross-event").alias("family")
    )


def confusion(results: DataFrame) -> DataFrame:
    """(family, truth, answer, n, correct) from rows with family, truth and answer."""
    return results.groupBy("family", "truth", "answer").agg(F.count("*").alias("n")).withColumn(
        "correct", F.col("truth") == F.col("answer")
    )


def accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("family").agg(
        F.count("*").alias("cases"), F.count_if(F.col("truth") == F.col("answer")).alias("right"),
        F.avg((F.col("truth") == F.col("answer")).cast("double")).alias("accuracy"),
    )
