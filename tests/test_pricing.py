import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from oddsgraph.functions.fees import fee_rate, taker_fee
from oddsgraph.operators import pricing as p
from oddsgraph.operators import screen as s

LEVELS = "token_id string, side string, price double, size double"


def fee(shares, price, rate):
    f = shares * rate * price * (1 - price)
    return f if shares > 0 and f >= 1e-5 else 0.0


def walk(levels, size, rate, limit=None, buy=True):
    left, notional, fees, used = size, 0.0, 0.0, 0
    for price, depth in sorted(levels, key=lambda x: x[0] if buy else -x[0]):
        if left <= 0 or (limit is not None and ((price > limit) if buy else (price < limit))):
            break
        take = min(left, depth)
        notional += take * price
        fees += fee(take, price, rate)
        used += 1
        left -= take
    return size - left, notional, fees, used


def random_book(r):
    return [(round(r.choice(range(1, 100)) / 100, 2), float(r.randint(1, 60))) for _ in range(r.randint(1, 8))]


def merge(levels):
    out = {}
    for price, size in levels:
        out[price] = out.get(price, 0.0) + size
    return sorted(out.items())


@pytest.mark.parametrize("buckets", [1, 4])
def test_walk_matches_a_plain_loop(spark, buckets):
    r = random.Random(5)
    books = {f"t{i}": (random_book(r), random_book(r)) for i in range(12)}
    levels = spark.createDataFrame(
        [(t, sd, a, b) for t, (bids, asks) in books.items() for sd, lv in (("bid", bids), ("ask", asks)) for a, b in lv]
        + [("t0", "ask", 0.0, 5.0), ("t0", "ask", 1.2, 5.0), ("t0", "bid", 0.5, 0.0), ("t0", "bid", float("nan"), 3.0)],
        LEVELS,
    )
    orders, want = [], {}
    for i in range(60):
        t = r.choice(list(books))
        buy, size = r.random() < 0.5, float(r.randint(1, 150))
        limit = r.choice([None, 0.3, 0.6])
        orders.append((i, t, "buy" if buy else "sell", size, 0.07, limit))
        want[i] = walk(merge(books[t][1 if buy else 0]), size, 0.07, limit, buy)
    df = spark.createDataFrame(
        orders + [(99, "nowhere", "buy", 5.0, 0.07, None)],
        "order_id int, token_id string, action string, size double, fee_rate double, limit_price double",
    )
    got = {x["order_id"]: x for x in p.walk_orders(df, levels, buckets).collect()}
    assert got[99]["filled"] == 0 and got[99]["unfilled"] == 5 and got[99]["avg_price"] is None
    for i, (filled, notional, fees, used) in want.items():
        x = got[i]
        assert math.isclose(x["filled"], filled, abs_tol=1e-9) and math.isclose(x["notional"], notional, abs_tol=1e-9)
        assert math.isclose(x["fee"], fees, abs_tol=1e-9) and x["levels_consumed"] == used
        assert x["partial"] == (0 < filled < x["size"])
    for x in p.size_within_slippage(levels, 0.1, buckets).collect():
        bids, asks = books[x["token_id"]]
        buy = x["side"] == "ask"
        book = merge(asks if buy else bids)
        touch = book[0][0] if buy else book[-1][0]
        total = sum(d for _, d in book)
        lo, hi = 0.0, total

        def slip(n):
            f, no, _, _ = walk(book, n, 0.0, None, buy)
            return ((no / f - touch) if buy else (touch - no / f)) / touch

        if slip(total) <= 0.1 + 1e-12:
            lo = total
        else:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if slip(mid) <= 0.1 else (lo, mid)
        assert math.isclose(x["size"], lo, rel_tol=1e-6), x


def basket(spark, n_legs, books, meta=None):
    markets = spark.createDataFrame(
        [(f"m{i}", [f"y{i}", f"n{i}"], ["Yes", "No"]) for i in range(n_legs)],
        "condition_id string, clob_token_ids array<string>, outcomes array<string>",
    )
    levels = spark.createDataFrame([(t, "ask", a, b) for t, lv in books.items() for a, b in lv], LEVELS)
    meta_df = spark.createDataFrame([(t, 5.0) for t in (books if meta is None else meta)], "token_id string, min_order_size double")
    return markets, levels, meta_df


@pytest.mark.parametrize("buckets", [1, 3])
def test_sweep_beats_every_grid_size_and_finds_break_even(spark, buckets):
    r = random.Random(11)
    cases, legs, books = {}, [], {}
    for k in range(40):
        n = r.randint(2, 4)
        cases[f"c{k}"] = n
        for i in range(n):
            t = f"{k}_{i}"
            books[t] = [(round(r.uniform(0.02, 0.9 / n), 3), float(r.randint(3, 60))) for _ in range(r.randint(1, 6))]
            legs.append((f"c{k}", "partition", "under", (0, t), t, 0, 1.0, t, "Yes", 5.0, True))
    legs_df = spark.createDataFrame(
        legs,
        "constraint_key string, kind string, direction string, leg struct<pos:int,condition_id:string>, condition_id string,"
        "outcome_index int, payout double, token_id string, outcome string, min_order_size double, has_book boolean",
    )
    levels = spark.createDataFrame([(t, "ask", a, b) for t, lv in books.items() for a, b in lv], LEVELS)
    trades, leg_rows = p.price_baskets(legs_df, levels, min_net_profit=-1e9, min_net_edge=-1e9, buckets=buckets)
    got = {x["constraint_key"]: x for x in trades.collect()}
    seen = 0
    for key, n in cases.items():
        lv = [merge(books[f"{key[1:]}_{i}"]) for i in range(n)]
        cap = min(sum(d for _, d in x) for x in lv)

        def profit(size, lv=lv):
            return size - sum(sum(walk(x, size, 0.07)[1:3]) for x in lv)

        x = got[key]
        if cap < 5:
            assert x["failure"] == "below-min-size"
            continue
        if profit(5.0) <= 0:
            assert x["failure"] == "negative-edge"
            continue
        seen += 1
        best = max(profit(5 + (cap - 5) * j / 400) for j in range(401))
        assert x["net_profit"] >= best - 1e-6
        assert math.isclose(x["net_profit"], profit(x["size"]), abs_tol=1e-6)
        top = x["max_executable_size"]
        assert top == pytest.approx(cap) or abs(profit(top)) < 1e-6
    assert seen > 5
    per = rows(leg_rows.groupBy("constraint_key").agg(F.count("*").alias("n")))
    assert all(cases[k] == n for k, n in per)


def test_failure_codes_and_confirmation(spark):
    markets, levels, meta = basket(
        spark, 6,
        {"y0": [(0.3, 100.0)], "y1": [(0.4, 100.0)], "n0": [(0.5, 3.0)], "y2": [(0.9, 50.0)], "y3": [(0.5, 50.0)],
         "n4": [(0.495, 50.0)], "y5": [(0.48, 6.0)]},
        meta=["y0", "y1", "n0", "y2", "y3", "n1", "n4", "y5"],
    )
    promoted = spark.createDataFrame(
        [("good", "complement", "under", 2, "m0", 0.3), ("thin", "implies", "over", 2, "m0", 0.1),
         ("empty", "complement", "over", 2, "m0", 0.1), ("loss", "complement", "under", 2, "m2", 0.1),
         ("gone", "complement", "over", 2, "m2", 0.1), ("token", "implies", "over", 2, "zz", 0.1),
         ("tiny", "implies", "over", 2, "m4", 0.1)],
        "constraint_key string, kind string, direction string, members int, first_condition_id string, magnitude double",
    )
    members = spark.createDataFrame(
        [("good", "complement", 0, "m0"), ("good", "complement", 1, "m1"), ("thin", "implies", 0, "m0"),
         ("thin", "implies", 1, "m1"), ("empty", "complement", 0, "m1"), ("empty", "complement", 1, "m1"),
         ("loss", "complement", 0, "m2"), ("loss", "complement", 1, "m3"), ("gone", "complement", 0, "m2"),
         ("gone", "complement", 1, "m3"), ("token", "implies", 0, "zz"), ("token", "implies", 1, "m1"),
         ("tiny", "implies", 0, "m4"), ("tiny", "implies", 1, "m5")],
        "constraint_key string, kind string, pos int, condition_id string",
    )
    legs = p.locate_legs(s.basket_legs(promoted, members), markets, meta)
    trades, _ = p.price_baskets(legs, levels)
    out = p.confirmations(promoted, trades, p.live_magnitude(promoted, members, markets, levels))
    got = {x["constraint_key"]: (x["failure"], x["status"]) for x in out.collect()}
    assert got == {
        "good": (None, "confirmed"), "thin": ("below-min-size", "apparent"), "empty": ("empty-book", "apparent"),
        "loss": ("negative-edge", "apparent"), "gone": ("missing-book", "apparent"),
        "token": ("missing-token", "apparent"), "tiny": ("negative-edge", "apparent"),
    }


def test_evaluate_rules(spark):
    members = spark.createDataFrame(
        [("i", "implies", 0, "a"), ("i", "implies", 1, "b"), ("j", "implies", 0, "b"), ("j", "implies", 1, "a"),
         ("c", "complement", 0, "a"), ("c", "complement", 1, "b"), ("p", "partition", 0, "a"), ("p", "partition", 0, "b"),
         ("p", "partition", 0, "c"), ("u", "implies", 0, "a"), ("u", "implies", 1, "none"), ("lost", "implies", 0, "a")],
        "constraint_key string, kind string, pos int, condition_id string",
    )
    prices = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "condition_id string, price double")
    e = s.evaluate(s.attach_prices(members, prices))
    got = {x["constraint_key"]: (round(x["magnitude"], 6), x["direction"], x["violated"], x["unscreenable"]) for x in e.collect()}
    assert got == {
        "i": (0.3, "over", True, False), "j": (-0.3, None, False, False), "c": (0.1, "under", True, False),
        "p": (0.0, None, False, False), "u": (0.0, None, False, True),
    }
    assert s.screen_stats(e).collect()[0] == (5, 2, 2, 1)
    legs = rows(s.basket_legs(s.promote(e), members), "constraint_key", "condition_id", "outcome_index", "payout")
    assert legs == [("c", "a", 0, 1.0), ("c", "b", 0, 1.0), ("i", "a", 1, 1.0), ("i", "b", 0, 1.0)]


def test_fee_rules(spark):
    df = spark.createDataFrame([("CRYPTO", 10), ("sports", 0), (None, None), ("weird", 1000)], "c string, b int")
    got = [x[0] for x in df.select(fee_rate(F.col("c"), F.col("b"))).collect()]
    assert got == [0.07, 0.0, 0.07, 0.07]
    small = spark.range(1).select(taker_fee(F.lit(1e-4), F.lit(0.5)), taker_fee(F.lit(100.0), F.lit(0.5))).collect()[0]
    assert small[0] == 0.0 and small[1] == pytest.approx(1.75)
