import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import decontaminate

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def likeness(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def best_windows(docs, items):
    """(doc_id, item_id) -> best similarity over every window of the item's size."""
    out = {}
    for doc_id, text in docs:
        whole = shingles(text)
        seen = set(whole)
        for item_id, item in items:
            goal = shingles(item)
            if not goal or not seen & set(goal):
                continue
            best = max(likeness(whole[s : s + len(goal)], goal) for s in range(max(1, len(whole) - len(goal) + 1)))
            if best >= 0.8:
                out[doc_id, item_id] = best
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_every_window(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
    want = best_windows(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    got = found(decontaminate.op2_decontaminate(spark, folder))
    assert want and got == pytest.approx(want)


def test_edited_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(25)]
    items.append((90, " ".join(["again and again and"] * 9)))
    docs = []
    for k in range(150):
        words = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [word()], [words[at], word()]])
        words = words[rng.choice([0, 0, 1, 4]) :]
        docs.append((k, "".join([" ".join(word() for _ in range(rng.randint(0, 80))), " ", " ".join(words).upper(), ", ", " ".join(word() for _ in range(rng.randint(0, 80)))])))
    want = best_windows(docs, items)
    got = found(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert all(got[k] == pytest.approx(want[k]) for k in got) and len(want) > 50
    assert len(got) >= 0.98 * len(want)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, None, "x"), (2, "", "x"), (3, passage, "x"), (3, passage, "x"), (None, "so " + passage.replace(" ", "\n"), "x"), (None, "clean words that hold nothing of it", "x"),
            (6, "w " * 100_000 + passage, "x"), (7, "just three words", "x"), (8, "here are just three words", "x"), (9, "eins zwei drei vier fünf", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumn("similarity", F.lit("mine"))
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "Just three words!"), (None, passage)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(3, 1), (None, 1), (6, 1), (7, 4)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.text or "" for r in kept.collect())) == sorted(["", "", rows[5][1], rows[8][1], rows[9][1]])
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(spark):
    plan = decontaminate.op2_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
