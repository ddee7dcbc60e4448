import random

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import rows

from oddsgraph.operators import relations
from oddsgraph.plans import queries


def market(name, low, high, event="e", subject="Will X close"):
    return (name, event, f"{subject} between ${low}K and ${high}K on Friday?")


def test_overlaps_and_findings_equal_all_pairs(spark):
    """One family holds most bands, one band is wider than all others together, starts repeat."""
    r = random.Random(6)
    data = [("wide", 0, 900), ("same1", 5, 7), ("same2", 5, 7)] + [(f"m{k:03d}", lo := r.randint(0, 60), lo + r.randint(1, 4)) for k in range(150)]
    made = [market(*d) for d in data]
    other = [("o1", 5, 7), ("o2", 6, 9)]
    made += [market(*d, event="other") for d in other] + [("none", "e", "Will it rain?"), ("blank", None, None)]
    df = spark.createDataFrame(made, "condition_id string, event_id string, question string")

    def pairs(family):
        return [(a, b) for a, la, ha in family for b, lb, hb in family if (la, a) < (lb, b) and lb < ha]

    assert rows(relations.overlapping_bands(df), "a_condition_id", "b_condition_id") == sorted(pairs(data) + pairs(other))
    asked = [("wide", "m001"), ("same1", "same2"), ("same1", "o1"), ("none", "wide"), ("gone", "wide"), ("o1", "o1")] + [(f"m{r.randrange(150):03d}", f"m{r.randrange(150):03d}") for _ in range(80)]
    at = {n: (lo, hi, "e") for n, lo, hi in data} | {n: (lo, hi, "other") for n, lo, hi in other}

    def finding(a, b):
        if a not in at or b not in at:
            return "unproven"
        (la, ha, fa), (lb, hb, fb) = at[a], at[b]
        return "unrelated" if fa != fb else "exclusive" if ha <= lb or hb <= la else "overlapping"

    got = rows(relations.verify_exclusive(spark.createDataFrame(asked, "a_condition_id string, b_condition_id string"), df))
    assert got == sorted((a, b, finding(a, b)) for a, b in asked) and len({x[2] for x in got}) == 4
    assert relations.overlapping_bands(df.limit(0)).count() == 0


def test_equal_bands_meet_as_blocks(spark, monkeypatch):
    """Of 300 bands with three intervals, the join sees blocks; the pairs are all there."""
    monkeypatch.setattr(relations, "BLOCK", 40)
    data = [(f"m{k:03d}", 5 + k % 3, 7 + k % 3) for k in range(300)]
    df = spark.createDataFrame([market(*d) for d in data], "condition_id string, event_id string, question string")
    found = relations.overlapping_bands(df)
    want = sorted((a, b) for a, la, ha in data for b, lb, hb in data if (la, a) < (lb, b) and lb < ha)
    assert rows(found, "a_condition_id", "b_condition_id") == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner") :]  # what meets by cell are the blocks' lists of ids
    assert "a_ids" in join and "a_condition_id" not in join


def test_a_task_of_exclusions_keeps_its_share(spark, monkeypatch, tmp_path):
    """More lines are dealt over more tasks, at each grouping and join."""
    monkeypatch.setattr(queries, "LINES_AT_ONCE", 100)
    pq.write_table(pa.table({"l_partkey": [k % 900 + 1 for k in range(3000)], "l_linenumber": pa.array([k % 7 for k in range(3000)], pa.int32())}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": range(1, 801), "p_brand": ["B"] * 800, "p_type": ["T"] * 800, "p_size": pa.array([k % 50 for k in range(800)], pa.int32())}), tmp_path / "part.parquet")
    plan, found = [], queries.QUERIES["verified_exclusions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 3
    got = {r.finding: (r.pairs, r.times) for r in found.collect()}
    size = {k + 1: k % 50 for k in range(800)}
    times, want = {}, {}
    for k in range(3000):
        a = k % 900 + 1
        times[a, a + k % 7 * 25] = times.get((a, a + k % 7 * 25), 0) + 1
    for (a, b), n in times.items():
        finding = "unproven" if a not in size or b not in size else "exclusive" if abs(size[a] - size[b]) >= 2 else "overlapping"
        pairs, total = want.get(finding, (0, 0))
        want[finding] = (pairs + 1, total + n)
    assert got == want
