import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import ppm

K = 5
SF = "/root/testdata/sf0.001"


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        out = out.replace(space, " ")
    return [w for w in out.split(" ") if w] + ["<end>"]


def symbols(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [254] * K + list(low.encode()) + [255]


class ByHand:
    """The trie as dictionaries, every step of a prediction spelt out."""

    def __init__(self, training):
        self.after = defaultdict(Counter)
        for text in training:
            s = symbols(text)
            for i in range(K, len(s)):
                for k in range(K + 1):
                    self.after[tuple(s[i - k : i])][s[i]] += 1

    def log(self, s, i):
        total, excluded = 0.0, set()
        for k in range(K, -1, -1):
            follow = self.after.get(tuple(s[i - k : i]))
            if not follow:
                continue
            left = {x: c for x, c in follow.items() if x not in excluded}
            room = sum(left.values()) + len(left)
            if s[i] in left:
                return total + math.log10(left[s[i]] / room)
            if room:
                total += math.log10(len(left) / room)
            excluded |= set(follow)
        return total - math.log10(257 - len(excluded))

    def score(self, text):
        s = symbols(text)
        return sum(self.log(s, i) for i in range(K, len(s)))

    def chances(self, context):
        """Of every symbol after a context."""
        return sum(10 ** self.log([*context, x], len(context)) for x in range(257))


def by_hand(rows, learns):
    training = [t for d, t in rows if learns(d)]
    model, counts = ByHand(training), Counter(w for t in training for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out.append((d, not learns(d), len(w), sum(counts[x] > 0 for x in w), n, base, model.score(t)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], str(r[6])[:9])


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-9)


def learned(d):
    return zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2


@pytest.mark.parametrize("hot", [(1_000_000, 250_000), (300, 40)])
def test_whole_table(spark, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot[0])
    monkeypatch.setattr(ppm, "HOT_WORDS", hot[1])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = ppm.op5_ppm(spark, SF).collect()
    same(got, by_hand(rows, learned))
    held = [r for r in got if r.held_out]
    letters = sum(len(r[1]) for r in rows if not learned(r[0]))
    assert held and sum(r.score for r in held) > -0.8 * letters  # under 2.7 bits a character


def test_chances_add_up():
    model = ByHand(["abracadabra", "the cat sat on the mat", "é"])
    for context in ("cabra", "zzzzz", "the c", "xxabr"):
        assert model.chances([*context.encode()]) == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "abra abra"), (3, "abra abra"), (None, "cadabra"), (16, "é\n漢字 😀"), (5, "a" * 50_000), (9, "Abra \t ABRA"), (23, "zebra \x00"), (27, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 9 != 5
    same(ppm.score(docs, learn).collect(), by_hand(rows, lambda d: (d or 0) % 9 != 5))
    same(ppm.score(docs, F.lit(False)).collect(), by_hand(rows, lambda d: False))
    assert ppm.score(docs.limit(0), learn).count() == 0
