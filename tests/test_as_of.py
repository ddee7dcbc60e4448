import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from oddsgraph.operators import pricing
from oddsgraph.scale import last_before

START = datetime(2025, 1, 1)


@pytest.mark.parametrize("buckets", [1, 6])
def test_as_of_equals_a_search_by_hand(spark, buckets):
    """One token holds most rows, times repeat, one key is null, some tokens have no book or no order."""
    r = random.Random(buckets)
    tokens = ["hot"] * 12 + ["b", "c", None]
    quotes = [(r.choice([*tokens, "quiet"]), START + timedelta(seconds=r.randint(0, 90)), k, float(k)) for k in range(300)]
    orders = [(r.choice([*tokens, "unknown"]), START + timedelta(seconds=r.randint(-5, 120)), k) for k in range(200)]
    left = spark.createDataFrame(orders, "token_id string, ts timestamp, order_id int").repartition(3)
    right = spark.createDataFrame(quotes, "token_id string, ts timestamp, seq int, price double").repartition(3)
    want = []
    for token, at, k in orders:
        before = [(ts, seq, price) for t, ts, seq, price in quotes if t == token and ts <= at]
        want.append((k, *(max(before)[1:] if before else (None, None))))
    got = last_before(left, right, ["token_id"], "ts", ["seq", "price"], buckets=buckets, tie=["seq"])
    assert rows(got, "order_id", "last_seq", "last_price") == sorted(want, key=lambda t: tuple(str(x) for x in t))
    assert sum(w[1] is None for w in want) > 5


def test_books_at_carries_whole_books(spark):
    books = spark.createDataFrame([("t", START, [(0.3, 5.0)], "h1"), ("t", START + timedelta(minutes=2), [], "h2")], "token_id string, ts timestamp, bids array<struct<price double, size double>>, hash string")
    orders = spark.createDataFrame([("t", START + timedelta(minutes=m), m) for m in (0, 1, 2, 5)] + [("u", START, 9)], "token_id string, ts timestamp, id int")
    got = {r.id: (r.book_hash, len(r.book_bids) if r.book_bids is not None else None) for r in pricing.books_at(orders, books).collect()}
    assert got == {0: ("h1", 1), 1: ("h1", 1), 2: ("h2", 0), 5: ("h2", 0), 9: (None, None)}
    assert pricing.books_at(orders.limit(0), books).count() == 0
