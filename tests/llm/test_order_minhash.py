import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from oddsgraph.llm import order_minhash as om

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    """Spark's xxhash64 of strings and numbers, chained."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & M).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def hashed_int(h, n):
    """(long, int): an int is hashed by its four bytes."""
    return xxhash.xxh64((n & 0xFFFFFFFF).to_bytes(4, "little"), seed=hashed(h)).intdigest()


def by_hand(text):
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)
    kmers = [hashed(a, b) for a, b in zip(tokens, tokens[1:])] if len(tokens) > 1 else [hashed(t) for t in tokens]
    seen, bins = Counter(), {}
    for place, h in enumerate(kmers):
        g = hashed_int(h, seen[h >> 28])
        seen[h >> 28] += 1
        bins.setdefault(g >> 58, []).append((g >> 28, place))
    out = []
    for b in sorted(bins):
        places = sorted(p for _, p in sorted(bins[b])[:2])
        out.append(b << 32 | hashed(*[kmers[p] for p in places]) & 0xFFFFFFFF)
    return out


def text_of(fp):
    return "".join(f"{x:010x}" for x in fp)


def alike(a, b):
    either = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def whole(rows):
    """Contract by hand: rows are (doc_id, text)."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1]))))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, b, c = by_hand(t), by_hand(edited), by_hand(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), alike(a, b), alike(a, c)))
    return out


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple(map(str, r))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = as_rows(om.op4_order_minhash(spark, SF))
    assert sorted(got, key=key) == sorted(whole(rows), key=key)
    assert sum(r[5] for r in got) / len(got) > 0.2 > sum(r[6] for r in got) / len(got) + 0.1


def odd(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("range", F.lit(1))
    out = om.with_next(docs)
    return {(r.doc_id, r.text, r.next_text) for r in out.collect()}, out.count()


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, "a b a b a b " * 30_000), (3, "Ωé 漢字 😀"), (3, "Ωé 漢字 😀"), (3, "zz"), (None, "n"), (-7, "x" * 100)]
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1]))))
    got, n = odd(spark, rows)
    assert n == len(rows) and got == {(d, t, u) for (d, t), (_, u) in zip(order, order[1:] + order[:1])}
    assert odd(spark, [(1, "alone")])[0] == {(1, "alone", "alone")}
    assert odd(spark, [(None, "a"), (None, "a")]) == ({(None, "a", "a")}, 2)
    assert odd(spark, []) == (set(), 0)


def test_order_matters(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    blocks = [words[k : k + 15] for k in range(0, 900, 15)]
    rng.shuffle(blocks)
    moved = " ".join(w for b in blocks for w in b)
    some = words.copy()
    for at in rng.sample(range(900), 20):
        some[at] = "edited"
    rows = [(" ".join(words), moved, " ".join(some))]
    a, b, c = (spark.createDataFrame(rows, "a string, b string, c string").select(*[om.order_minhash(F.col(x)) for x in "abc"]).head())
    assert alike(a, a) == 1 and alike(a, c) > 0.75 and alike(a, b) < 0.6


@pytest.mark.parametrize("text", ["a", "a b", "a a a a a a", "", " \n", "one two one two one two three"])
def test_short_texts(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(om.order_minhash(F.col("t"))).head()[0]
    assert got == by_hand(text)


def test_no_python_in_the_plan(spark):
    plan = om.op4_order_minhash(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
