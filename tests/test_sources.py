import json

from conftest import rows
from pyspark.sql import functions as F

from oddsgraph.functions import coerce
from oddsgraph.operators import screen
from oddsgraph.plans.queries import QUERIES
from oddsgraph.sources import books, pages, synthetic, tables


def land(spark, *bodies):
    return spark.createDataFrame([(f"p{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "page string, body string")


def coerced(spark, how, values):
    df = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(values)], "i int, body string")
    found = coerce.soft(df.select("i", F.try_parse_json("body").alias("record")), {"x": how}, {})
    out = found.select("value.x", "issues", "i").orderBy("i").collect()
    for r, given in zip(out, values, strict=True):
        for issue in r.issues:
            assert (issue.field, issue.reason, json.loads(issue.received)) == ("x", coerce.EXPECTED[how], given)
    return [(r.x, bool(r.issues)) for r in out]


def test_aliases_and_several_fields(spark):
    bodies = [{"a": "", "b": 5, "c": "no"}, {"a": 7, "b": "x"}, {"a": None, "b": None, "c": 9}, {}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    found = coerce.soft(df.select("i", F.try_parse_json("body").alias("record")), {"a": "numeric", "c": "boolean"}, {"a": "b", "z": "c"})
    got = [(r.a, r.c, [(x.field, x.received) for x in r.issues]) for r in found.select("value.*", "issues", "i").orderBy("i").collect()]
    assert got == [(5.0, False, []), (7.0, None, []), (None, None, [("c", "9")]), (None, None, [])]


def test_field_coercions(spark):
    assert coerced(spark, "numeric", [12.5, "12.5", " 3 ", "1e3", "abc", "NaN", "Infinity", "1d", "", None, [1], True]) == [
        (12.5, False), (12.5, False), (3.0, False), (1000.0, False), (None, True), (None, True), (None, True),
        (None, True), (None, False), (None, False), (None, True), (None, True),
    ]
    assert coerced(spark, "boolean", [True, "TRUE", "no", 1, 0, 2, "maybe", " "]) == [
        (True, False), (True, False), (False, False), (True, False), (False, False), (None, True), (None, True), (None, False),
    ]
    assert coerced(spark, "identifier", ["253", 253, " a ", {"a": 1}]) == [("253", False), ("253", False), ("a", False), (None, True)]
    assert coerced(spark, "strings", [["Yes", "No"], '["Yes","No"]', "[1, 2]", '["0.5",null]', "[oops", {"a": 1}, 5]) == [
        (["Yes", "No"], False), (["Yes", "No"], False), (["1", "2"], False), (None, True), (None, True), (None, True), (None, True),
    ]
    assert coerced(spark, "numbers", ['["0.51","0.49"]', '["0.51","abc"]', []]) == [([0.51, 0.49], False), (None, True), ([], False)]
    assert [b for _, b in coerced(spark, "url", ["https://a.b", "ftp://x"])] == [False, True]
    assert [b for _, b in coerced(spark, "string", ["a", 5])] == [False, True]


def test_timestamps(spark):
    values = [
        "2025-03-01T12:00:00Z", "2025-03-01", "2024-01-01 20:24:52+00", 1735689600, "1735689600000", 1735689600000,
        "2025-02-30", "0000-00-00", "N/A", "2025-03-01T12:00:00+02:00", "2025-03-01T12:00:00.250Z",
    ]
    df = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(values)], "i int, body string")
    found = coerce.soft(df.select("i", F.try_parse_json("body").alias("record")), {"x": "timestamp"}, {})
    got = [(r[0], r[1]) for r in found.select(F.date_format("value.x", "yyyy-MM-dd HH:mm:ss.SSS"), F.size("issues") > 0, "i").orderBy("i").collect()]
    assert got == [
        ("2025-03-01 12:00:00.000", False), ("2025-03-01 00:00:00.000", False), ("2024-01-01 20:24:52.000", False),
        ("2025-01-01 00:00:00.000", False), ("2025-01-01 00:00:00.000", False), ("2025-01-01 00:00:00.000", False),
        (None, True), (None, True), (None, True), ("2025-03-01 10:00:00.000", False), ("2025-03-01 12:00:00.250", False),
    ]


def test_page_envelopes(spark):
    df = land(
        spark, [{"id": 1}], {"data": [{"id": 1}, {"id": 2}], "next_cursor": "abc"}, {"events": [], "nextCursor": "LTE="},
        {"things": [{"id": 3}], "limit": 5}, {"a": [1], "b": [2]}, "oops", {"markets": "no"},
    )
    got = pages.open_pages(df).select("page", F.size("records"), F.col("records").isNull(), "next_cursor").orderBy("page").collect()
    assert [(r[1] if not r[2] else None, r[3]) for r in got] == [
        (1, None), (2, "abc"), (0, None), (1, None), (None, None), (None, None), (None, None),
    ]


def test_catalog_isolates_bad_records(spark):
    body = {
        "events": [
            {"id": "e1", "title": "T", "negRisk": "true", "tags": [{"id": 5, "label": "L"}], "markets": [
                {"id": 1, "conditionId": "c1", "questionID": "q", "volume": "", "volumeNum": 7, "new": True, "endDate": "2025-02-30",
                 "outcomes": '["Yes","No"]'},
                {"conditionId": "c2"}, None, "text"]},
            {"title": "no id", "markets": [{"id": 9}]},
        ]
    }
    cat = pages.normalise_catalog(land(spark, body, {"nothing": 1}))
    m = cat.markets.collect()
    assert len(m) == 1 and m[0]["volume"] == 7 and m[0]["isNew"] is True and m[0]["questionId"] == "q"
    assert m[0]["endDate"] is None and m[0]["event_id"] == "e1" and m[0]["outcomes"] == ["Yes", "No"]
    e = cat.events.collect()
    assert [x["id"] for x in e] == ["e1"] and e[0]["negRisk"] is True and e[0]["tags"][0]["id"] == "5"
    assert rows(cat.issues, "kind", "id", "field") == [("market", "1", "markets[0].endDate")]
    assert rows(cat.rejects.groupBy("kind").count()) == [("event", 1), ("market", 3), ("page", 1)]
    assert rows(cat.counters) == [("event", 1, 0), ("market", 1, 1)]


def test_archive_keeps_one_body_per_hash(spark):
    p = land(spark, '{"b":1,"a":2}', '{"a":2,"b":1}', "not json", "not json")
    first = pages.archive_pages(None, p, F.lit("2025-01-01").cast("timestamp"))
    assert first.count() == 2
    assert pages.archive_pages(first, p, F.current_timestamp()).count() == 0


def test_archive_tells_texts_apart_that_begin_with_json(spark):
    p = land(spark, "829 one text", "829 another text", "829", " 829 ", "1],[2", "1},{2", "1,2", '{"a":1} x', '{"a":1}')
    assert pages.archive_pages(None, p, F.current_timestamp()).count() == 8


def test_archived_documents_are_distinct_texts(spark, tmp_path):
    texts = ["7 one", "7 two", "7", " 7", "7.0", "{}", "", None, None, '{"b":1,"a":2}', '{"a":2,"b":1}', "plain", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(int(r.endpoint) for r in QUERIES["archive_dedupe"](spark, str(tmp_path)).collect())
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]


def test_books_are_sorted_and_clean(spark):
    wire = [{"market": "c", "asset_id": "t", "timestamp": "1735689600000", "hash": "h", "bids": [
        {"price": "0.01", "size": "5"}, {"price": "0.40", "size": "1"}, {"price": "0.40", "size": "2"}, {"price": "x", "size": "2"}],
        "asks": [{"price": "0.9", "size": "5"}, {"price": "0.5", "size": "0"}, {"price": "0.6", "size": "3"}, {"price": "1.5", "size": "3"}],
        "min_order_size": 5, "tick_size": "0.01"}]
    b = books.parse_books(land(spark, wire))
    r = b.collect()[0]
    assert [(x["price"], x["size"]) for x in r["bids"]] == [(0.4, 1.0), (0.4, 2.0), (0.01, 5.0)]
    assert [(x["price"], x["size"]) for x in r["asks"]] == [(0.6, 3.0), (0.9, 5.0)]
    assert r["min_order_size"] == 5.0 and r["tick_size"] == 0.01
    wanted = spark.createDataFrame([("t",), ("u",), ("t",), ("",)], "token_id string")
    have, missing = books.books_for(wanted, b)
    assert have.count() == 1 and rows(missing) == [("u",)]


def test_versions_quotes_and_merge(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_current(spark, root) is None
    a = spark.createDataFrame([("c1", 0.1, None, None, None, None)], "condition_id string, yes_price double, best_bid double, best_ask double, quoted_at timestamp, fetched_at timestamp")
    tables.write_version(a, root)
    wanted = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "condition_id string")
    markets = spark.createDataFrame(
        [("c1", [0.3, 0.7], None, None, None, 2), ("c1", [0.4], None, None, None, 1), ("c2", [0.5], 0.4, 0.6, None, 3), (None, [0.5], None, None, None, 4)],
        "conditionId string, outcomePrices array<double>, bestBid double, bestAsk double, updatedAt timestamp, pos int",
    )
    merged, counts = tables.refresh_quotes(tables.read_current(spark, root), wanted, markets, F.lit("2025-01-01").cast("timestamp"), F.col("pos"))
    assert counts.collect()[0] == (3, 2, 1)
    tables.write_version(merged, root)
    assert rows(tables.read_current(spark, root), "condition_id", "yes_price") == [("c1", 0.4), ("c2", 0.5)]


def test_synthetic_catalog_screens(spark):
    cat = synthetic.synthetic_catalog(spark, 0.01)
    members = screen.constraint_members(cat.relations, cat.groups, cat.members, cat.markets)
    out = screen.screen_stats(screen.evaluate(screen.attach_prices(members, screen.cached_quotes(cat.quotes)))).collect()[0]
    assert out["evaluated"] == 676 + 242 and out["unscreenable"] == 0 and out["violated"] > 0
