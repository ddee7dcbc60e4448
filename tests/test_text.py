import re

from conftest import rows

from oddsgraph.functions import text
from oddsgraph.operators import relations

ABOVE = "Resolves Yes when the price is equal to or above the listed value."
BELOW = "Resolves Yes when the rating is at or below the listed value."


def parsed(spark, cases):
    df = spark.createDataFrame(cases, "i int, question string, description string")
    out = text.parse_thresholds(df).select("i", "parse.*").orderBy("i").collect()
    return [None if r["subject"] is None else (r["subject"], r["direction"], r["threshold"], r["unit"], r["date_text"]) for r in out]


def test_thresholds(spark):
    cases = [
        ("Will gold be above $2,750.50 on May 4 at noon?", None, ("will gold", "gt", 2750.5, "usd", "on may 4 at noon")),
        ("Will turnout be 49.5% or lower in March?", None, ("will turnout", "lt", 49.5, "percent", "in march")),
        ("Will the bank cut by 25+ bps after the June 2026 meeting?", None, ("will the bank cut", "gt", 25.0, "bps", "after the june 2026 meeting")),
        ("Will silver reach $40K by 2027?", ABOVE, ("will silver", "gt", 40000.0, "usd", "by 2027")),
        ("Will support hit 35% in 2026?", BELOW, ("will support", "lt", 35.0, "percent", "in 2026")),
        ("Will support hit 35% in 2026?", None, None),
        ("Will support hit 35% in 2026?", ABOVE + BELOW, None),
        ("Will it be 30°C or higher?", None, ("will it be ?", "gt", 30.0, "temperature", None)),
        ("Over 231.5", None, ("", "gt", 231.5, "count", None)),
        ("Will sales be between $4M and $5M?", None, None),
        ("Will sales be above $4M and below $9M?", None, None),
        ("Will gold hit $80k or $100k first?", ABOVE, None),
        ("Will it rain?", None, None),
        ("Will revenue exceed 3 billion in 2026?", None, ("will revenue", "gt", 3e9, "count", "in 2026")),
    ]
    got = parsed(spark, [(i, q, d) for i, (q, d, _) in enumerate(cases)])
    assert got == [w for _, _, w in cases]


def test_deadlines_bands_and_forms(spark):
    df = spark.createDataFrame([(q,) for q in [
        "Strike by December 31, 2026?", "Strike by 2.2%?", "Gold above $2 on May 4 by 2026?", "Will it be between $1.5K and $2K on Friday?",
        "between 5 and 3", "Will Ann not win and won't quit?"]], "question string")
    got = rows(text.parse_deadlines(df).where("deadline is not null").select("deadline.*"))
    assert got == [("strike", "december 31, 2026")]
    assert rows(text.parse_bands(df).where("band is not null").select("band.*")) == [("Will it be", "on Friday?", 1500.0, 2000.0)]
    forms = df.where("question like '%Ann%'").select(text.positive_forms(text.normalise_question(df.question)).alias("f")).collect()[0]["f"]
    assert set(forms) == {"will ann not win and will quit", "will ann win and will quit"}


def test_buckets_change_no_edges(spark):
    markets = spark.createDataFrame(
        [(f"m{i:03d}", "e1" if i % 3 else "e2", f"Will gold be above ${(i * 7) % 40}K on May 4?") for i in range(90)],
        "condition_id string, event_id string, question string",
    )
    rungs = relations.ladder_rungs(markets)
    one, many = relations.ladder_edges(rungs, 1), relations.ladder_edges(rungs, 5)
    assert rows(one) == rows(many) and one.count() > 50


def test_every_phrase_holds_the_letters_it_is_searched_by(spark):
    """Whatever a phrase's pattern finds, in any case and spelling, its letters find first."""
    forms, pattern = [], {p: re.compile(p, re.IGNORECASE) for p, *_ in [*text.LEADING, *text.TRAILING]}
    for p in pattern:
        words = "or higher" if p.startswith("or") and "higher" in p else "or lower" if p.startswith("or") else None
        for one in [words] if words else p.split("|") if "(" not in p else [re.sub(r"\(\?:.*\)\?", "", p)]:
            plain = one.replace(r"\s+", " ")
            forms += [plain.replace("s?", "s"), plain.replace("s?", "").upper(), plain.replace("?", "").replace(" ", "  ")]
    df = spark.createDataFrame([(f,) for f in forms], "f string").selectExpr("f", "lower(f) as __low")
    got = df.selectExpr("f", *[f"{text._names(p)} as p{k}" for k, p in enumerate(pattern)]).collect()
    found = [(row["f"], k) for row in got for k, p in enumerate(pattern.values()) if p.search(row["f"])]
    assert {k for _, k in found} == set(range(len(pattern)))
    assert all(row[f"p{k}"] for row in got for k, p in enumerate(pattern.values()) if p.search(row["f"]))
