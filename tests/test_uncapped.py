"""Nothing is dropped unless a limit is asked for, and results don't depend on row order."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from oddsgraph.operators import alerts, analytics, proposals, reconcile, screen
from oddsgraph.scale import top


def test_top(spark):
    rows = spark.range(1000)
    assert top(rows, None, "id").count() == 1000
    assert [r.id for r in top(rows, 3, F.desc("id")).collect()] == [999, 998, 997]


def test_every_violation_is_promoted(spark):
    found = spark.range(60).select(F.format_string("k%03d", "id").alias("constraint_key"), F.lit(True).alias("violated"), (F.col("id") / 100).alias("magnitude"))
    assert screen.promote(found).count() == 60
    assert [r.constraint_key for r in screen.promote(found, 2).collect()] == ["k059", "k058"]


def stored(spark):
    rows = [(proposals_id, f"a{k}", f"b{k}", "implies", "why", 0.9, "m", 0.8, "pending", None, None) for k, proposals_id in enumerate(["11", "12", "13"])]
    cols = "id string, low_condition_id string, high_condition_id string, proposed_type string, rationale string, model_confidence double, model string, similarity double, status string, reviewed_by string, review_note string"
    return spark.createDataFrame(rows, cols)


def test_first_verdict_wins(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# review\n12 r no link\n12 a\n11 a fine\n11 r\n99 a\nnonsense\n")
    verdicts = proposals.read_verdicts(spark, str(tmp_path / "v.txt"))
    after, edges, counts = proposals.apply_verdicts(stored(spark), verdicts, "me")
    assert {r.id: (r.status, r.review_note) for r in after.collect()} == {"11": ("accepted", "fine"), "12": ("rejected", "no link"), "13": ("pending", None)}
    assert [r.from_condition_id for r in edges.collect()] == ["a0"]
    assert tuple(counts.head())[:2] == (2, 2)


def test_samples_at_one_time_follow_the_tie(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", t, 0, 1), ("s", t + timedelta(seconds=60), 100, 2), ("s", t + timedelta(seconds=60), 200, 3), ("s", t + timedelta(seconds=120), 200, 4)]
    samples = spark.createDataFrame(rows, "source string, sampled_at timestamp, rate_limit_hits long, seq long").select(
        "*", F.col("sampled_at").alias("last_ingest_at"), F.lit(0).alias("queue_depth"), F.lit(0).alias("records"), F.lit(0).alias("parse_issues")
    )
    for order in ("seq", F.desc("seq")):
        found = alerts.system_findings(samples.orderBy(order), tie=["seq"]).collect()
        assert [(r.name, r.value) for r in found] == [("rate-limit-spike", 1000.0)]


def test_digest_counts_before_it_cuts(spark):
    t = datetime(2024, 1, 1, 10)
    episodes = spark.range(700).select(
        F.col("id").cast("string").alias("episode_id"), F.lit(t).alias("detected_at"), F.lit(False).alias("ever_confirmed"), (F.col("id") / 1000).alias("screen_magnitude"),
        F.concat(F.lit("x" * 100), (F.col("id") % 2).cast("string")).alias("reason"),
    )
    digest = alerts.hourly_digest(episodes, F.lit(t), F.lit(t + timedelta(hours=1)))
    assert digest["totals"].head().apparent == 700
    assert sorted(r.n for r in digest["by_reason"].collect()) == [350, 350]
    assert [r.episode_id for r in digest["worst"].collect()] == ["699", "698", "697", "696", "695"]


def test_newest_relations(spark):
    t = datetime(2024, 1, 1)
    rows = [(f"r{k}", "a", "b", "implies", "ladder", t + timedelta(hours=k)) for k in range(5)]
    relations = spark.createDataFrame(rows, "id string, from_condition_id string, to_condition_id string, type string, source string, first_seen_at timestamp")
    markets = spark.createDataFrame([("a", "A?"), ("b", "B?")], "condition_id string, question string")
    assert sorted(r.id for r in analytics.relations_feed(relations, markets, limit=2).collect()) == ["r3", "r4"]
    assert analytics.relations_feed(relations, markets).count() == 5


def test_later_pages_win_whatever_their_names(spark):
    pages = ["crawl/page-2.json", "crawl/page-10.json", "crawl/page-9.json"]
    rows = spark.createDataFrame([(p,) for p in pages], "page string")
    assert [r.page for r in rows.orderBy(reconcile.page_order(F.col("page"))).collect()] == ["crawl/page-2.json", "crawl/page-9.json", "crawl/page-10.json"]
    seen = F.lit(datetime(2024, 1, 1))
    events = spark.createDataFrame([("e", p, 0, p, "t", False, False) for p in pages], "id string, page string, position int, slug string, title string, negRisk boolean, closed boolean")
    none = reconcile.event_rows(events, seen).drop("arrival").where("false")
    assert reconcile.upsert_events(none, reconcile.event_rows(events, seen)).head().slug == "crawl/page-10.json"
