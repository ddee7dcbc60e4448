import random
import re
from collections import Counter, defaultdict

import pytest

from oddsgraph.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def by_hand(rows):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for _, text, lang, source in rows]
    docs = [(lang, source, ["".join(c.lower() if c.isascii() else c for c in w) for w in words]) for lang, source, words in docs]
    seen, whole, own = Counter(), Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        seen.update({(lang, w) for w in words})
        whole.update((lang, w) for w in words)
        own[lang, source].update(words)
    out = []
    for lang, source in own:
        kept = [w for (k, w), n in seen.items() if k == lang and n >= 3]

        def p(counts):
            total = sum(counts[w] for w in kept) + len(kept)  # noqa: B023
            return {w: 1 + 10**9 * (counts[w] + 1) // total for w in kept}  # noqa: B023

        mine, all_of = p(own[lang, source]), p(Counter({w: whole[lang, w] for w in kept}))
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(mine[w], q[w]) for w in kept)) for k, s in own if k == lang and s != source for q in [p(own[k, s])]]
        terms = [(w, f(mine[w], all_of[w])) for w in kept if own[lang, source][w] and mine[w] > all_of[w]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in dv.divergence(df).collect())


def some_rows(seed, sources, docs=160):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeß漢𝔘") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = []
    for k in range(docs):
        source = "hot" if rng.random() < 0.35 else f"s{rng.randrange(sources)}"
        mine = [rng.choice(words[: rng.choice([5, 50, 400])]) for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(w.upper() if rng.random() < 0.2 else w for w in mine), rng.choice(["en", "de", None]), source))
    return rows


@pytest.mark.parametrize(("terms", "tile", "sources"), [(4096, 128, 6), (20, 2, 9)])
def test_equals_brute_force(spark, monkeypatch, terms, tile, sources):
    monkeypatch.setattr(dv, "TERMS_IN_BLOCK", terms)
    monkeypatch.setattr(dv, "SOURCES_IN_TILE", tile)
    rows = some_rows(terms, sources)
    want = by_hand(rows)
    assert max(r[5] for r in want) > 30 and found(spark, rows) == want


def test_ties_across_the_last_rank(spark):
    """Three hundred terms of one cell: the first two hundred in UTF-8 order are reported."""
    text = " ".join(f"w{chr(0xE000 + k)}" if k % 2 else f"w{chr(0x10000 + k)}" for k in range(300))
    rows = [(k, text, "x", "a") for k in range(3)] + [(9, "other words here", "x", "b")] * 3
    want = by_hand(rows)
    assert sum(r[1:3] == ("a", "term") for r in want) == 200 and found(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, None, None), (2, "", "", "s"), (None, "12 34 _ \t", "en", "s"), (3, "It's A-b_c\x00ſK É", "en", "s"),
        (3, "It's A-b_c\x00ſK É", "en", "s"), (4, "it S a b\x7fc ſk É", "en", None), (5, "word " * 300_000 + "end", "en", "t"), (6, "word end", "en", "t"),
        (7, "end", "en", "u"), (8, "alone", "one", "only"),
    ]
    want = by_hand(rows)
    assert found(spark, rows) == want and ("", "", "pair", "s", 0, 1) in want
    assert found(spark, []) == []
