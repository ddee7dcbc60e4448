import json
import os
import random
import time
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from oddsgraph.operators import alerts
from oddsgraph.operators import episodes as ep
from oddsgraph.streaming import books, frames, quality, watch


def run(df, name, mode, tmp_path):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def change(token, side, price, size, ts, **extra):
    body = {"asset_id": token, "price": str(price), "size": str(size), "side": side, **extra}
    return {"event_type": "price_change", "market": "c-" + token, "timestamp": str(ts), "price_changes": [body]}


def book(token, bids, asks, ts, hash_="h"):
    def side(levels):
        return [{"price": str(p), "size": str(s)} for p, s in levels]

    return {"event_type": "book", "market": "c-" + token, "asset_id": token, "timestamp": str(ts), "hash": hash_, "bids": side(bids), "asks": side(asks)}


def test_frame_routing(spark):
    data = ["PONG", "INVALID OPERATION", "{oops", json.dumps([book("t", [], [], 1), {"event_type": "tick_size_change"}, {"x": 1}]), json.dumps(change("t", "BUY", 0.5, 1, 2)), ""]
    df = spark.createDataFrame([(d, datetime(2025, 1, 1)) for d in data], "frame string, received_at timestamp")
    got = dict(rows(frames.route_counts(frames.route_frames(df))))
    assert got == {"pong": 1, "text": 1, "unparseable": 1, "book": 1, "tick_size_change": 1, "unknown": 1, "price_change": 1}


def test_stream_books_match_the_batch_state(spark, tmp_path):
    r = random.Random(2)
    lines, ts = [], 1_000
    seeds = {}
    for i in range(300):
        ts += r.randint(1, 20)
        t = f"t{r.randint(0, 5)}"
        if t not in seeds and r.random() < 0.25:
            seeds[t] = ts
            lines.append(book(t, [(0.3, 5), (0.2, 7)], [(0.6, 4), (1.7, 3)], ts, f"s{i}"))
        else:
            lines.append(change(t, r.choice(["BUY", "SELL"]), round(r.choice([0.1, 0.2, 0.3, 0.6, 0.7, 1.5]), 2), r.choice([0, 3, 9]), ts, hash=f"h{i}"))
    src = tmp_path / "in"
    src.mkdir()
    for part in range(3):
        (src / f"{part}.txt").write_text("\n".join(json.dumps(x) for x in lines[part * 100 : part * 100 + 100]))
        os.utime(src / f"{part}.txt", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = frames.book_events(frames.route_frames(frames.read_frames(spark, str(src))))
    out = run(books.stream_books(stream), "book_updates", "update", tmp_path)
    events = frames.book_events(frames.route_frames(frames.read_frames(spark, str(src), streaming=False)))
    whole = events.where("kind = 'book'")
    seeded = whole.select("token_id", F.col("ts_ms").alias("seed_ts"))
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("lv")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("lv")))
    seed_rows = whole.select("token_id", F.inline(sides), F.col("ts_ms").alias("ts")).select("token_id", "side", F.inline("lv"), "ts", F.lit(-1).cast("long").alias("seq"))
    moves = events.where("kind = 'price_change'").select("token_id", "side", "price", "size", F.col("ts_ms").alias("ts"), "seq")
    batch = books.book_state(seed_rows.unionByName(moves), seeded)
    want = {k: (b, a) for k, b, a in rows(batch.groupBy("token_id").agg(F.max(F.expr("if(side='bid',price,null)")).alias("b"), F.min(F.expr("if(side='ask',price,null)")).alias("a")))}
    last = out.where("ts_ms is not null").groupBy("token_id").agg(F.max_by(F.struct("bid", "ask"), "ts_ms").alias("s"))
    got = {x["token_id"]: (x["s"]["bid"], x["s"]["ask"]) for x in last.collect()}
    assert got == want and len(got) >= 4
    quality = books.stream_quality(out).collect()[0]
    assert quality["seeded"] == len(want) and quality["applied"] > 0 and quality["unseeded"] > 0


def test_detections_fire_on_transitions_only(spark, tmp_path):
    src = tmp_path / "mids"
    src.mkdir()
    steps = [
        [("a", 0.5, 1000), ("b", 0.6, 1000)], [("a", 0.7, 2000)], [("a", 0.72, 3000)], [("b", None, 3500), ("a", 0.9, 3600)],
        [("b", 0.95, 4000)], [("b", 0.5, 5000)],
    ]
    for i, step in enumerate(steps):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"token_id": t, "mid": m, "ts_ms": x, "received_ms": x + 40}) for t, m, x in step))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "token_id string, mid double, ts_ms long, received_ms long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    index = spark.createDataFrame([("a", "k", "implies", 0, "A", 2), ("b", "k", "implies", 1, "B", 2)], "token_id string, constraint_key string, kind string, pos int, condition_id string, need int")
    out = run(watch.stream_detections(stream, index), "detections", "append", tmp_path)
    got = rows(out, "constraint_key", "at_ms", "latency_ms")
    assert got == [("k", 2000, 40), ("k", 5000, 40)]
    assert watch.latency_quantiles(out).collect()[0][0] == 40
    h = watch.latency_histogram(out).collect()[0]
    assert h["le_0_25"] == 2 and h["count"] == 2


def checks(spark, n=400):
    r = random.Random(9)
    start = datetime(2025, 1, 1)
    data = [
        (f"k{r.randint(0, 3)}", start + timedelta(seconds=37 * i), r.random() < 0.5, r.random() < 0.1, round(r.random(), 3),
         r.random() < 0.2, r.choice([None, 1.0, 5.0]), "why", "implies", 2, "m")
        for i in range(n)
    ]
    return spark.createDataFrame(
        data, "constraint_key string, check_ts timestamp, violated boolean, unscreenable boolean, magnitude double, confirmed boolean,"
        "net_profit double, reason string, kind string, members int, first_condition_id string",
    ).withColumn("net_edge", F.col("net_profit") / 10).withColumn("size", F.lit(10.0))


def test_stream_episodes_equal_batch_and_buckets_change_nothing(spark, tmp_path):
    df = checks(spark)
    path = str(tmp_path / "checks")
    df.orderBy("check_ts").coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    one, many = ep.episodes(stored, buckets=1), ep.episodes(stored, buckets=6)
    cols = ["constraint_key", "detected_at", "resolved_at", "checks", "ever_confirmed", "peak_magnitude", "peak_net_profit"]
    assert rows(one, *cols) == rows(many, *cols)
    assert rows(watch.transitions(stored, 1)) == rows(watch.transitions(stored, 5))
    assert watch.transitions(stored).count() == one.count()
    stream = spark.readStream.schema(stored.schema).parquet(path)
    out = run(watch.stream_episodes(stream), "closed_episodes", "append", tmp_path)
    assert rows(out, *cols) == rows(one.where("resolved_at is not null"), *cols)
    assert one.where("resolved_at is null").count() <= 4


def land(df, folder, parts, order="check_ts"):
    """Write rows as files of a stream, in order."""
    ordered = [r.asDict() for r in df.orderBy(order).collect()]
    folder.mkdir(exist_ok=True)
    size = -(-len(ordered) // parts)
    for k in range(parts):
        some = df.sparkSession.createDataFrame(ordered[k * size : k * size + size], df.schema).coalesce(1)
        some.write.mode("append").parquet(str(folder / f"part{k}"))
        for name in (folder / f"part{k}").glob("*.parquet"):
            os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))


def test_episodes_feed_the_digest_in_one_query(spark, tmp_path):
    """The hours told by the stream equal the batch digest, in one batch or in many."""
    df = checks(spark, 900).withColumn("reason", F.concat(F.lit("spread and fees"), F.expr("if(magnitude > 0.5, ' a', null)")))
    far = df.limit(1).withColumn("check_ts", F.lit(datetime(2025, 1, 3))).withColumn("violated", F.lit(False)).withColumn("unscreenable", F.lit(False))
    for parts in (1, 5):
        src = tmp_path / f"checks{parts}"
        land(df, src, parts)
        land(far, tmp_path / f"checks{parts}" / "end", 1)
        for name in (src / "end").rglob("*.parquet"):
            os.utime(name, (1_700_000_900, 1_700_000_900))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        out = run(watch.stream_digest(watch.stream_episode_changes(stream), "12 hours"), f"digest{parts}", "append", tmp_path)
        want = alerts.digests_by_hour(ep.episodes(df.unionByName(far)))
        got = rows(out, "hour", "reason", "n", "worst")
        assert got == rows(want, "hour", "reason", "n", "worst") and len(got) >= 9


def test_a_digest_takes_the_class_at_the_end_of_the_grace(spark, tmp_path):
    start = datetime(2025, 1, 1, 8, 50)
    steps = [(0, True, False, "too thin"), (20, True, False, "spread and fees"), (80, True, True, "x"), (90, False, False, None), (900, False, False, None)]
    df = spark.createDataFrame(
        [("k", start + timedelta(minutes=m), v, False, 0.5 + m, c, 1.0, why, "implies", 2) for m, v, c, why in steps],
        "constraint_key string, check_ts timestamp, violated boolean, unscreenable boolean, magnitude double, confirmed boolean, net_profit double, reason string, kind string, members int",
    )
    src = tmp_path / "grace"
    land(df, src, 5)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    for grace, want in (("30 minutes", "spread and fees exceed the mispricing"), ("3 hours", "confirmed")):
        out = run(watch.stream_digest(watch.stream_episode_changes(stream()), grace), "grace" + grace.split()[0], "append", tmp_path)
        assert rows(out) == [(datetime(2025, 1, 1, 8), want, 1, 0.5)]
    changes = run(watch.stream_episode_changes(stream()), "changes", "append", tmp_path)
    assert [r.change for r in changes.orderBy("at").collect()] == ["opened", "changed", "changed", "closed"]


def test_a_restart_goes_on_in_the_same_cooldown(spark, tmp_path):
    src = tmp_path / "found"
    src.mkdir()
    schema = "constraint_key string, kind string"

    def fired(name, cooldown, file, n=3):
        (src / f"{file}.json").write_text("\n".join(json.dumps({"constraint_key": f"k{i}", "kind": "implies"}) for i in range(n)))
        df = watch.stream_triggers(spark.readStream.schema(schema).json(str(src)), cooldown)
        q = df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        try:  # a stream with processing-time timers goes on without data, so it is stopped once it has read the file
            until = time.time() + 60
            while time.time() < until and not any(p.numInputRows for p in q.recentProgress):
                time.sleep(0.5)
        finally:
            q.stop()
        return sorted((r.detections, r.held_back) for r in spark.read.schema(watch.TRIGGER).parquet(str(tmp_path / name)).collect())

    assert fired("slow", 3600, 0) == [(3, 0)]
    assert fired("slow", 3600, 1) == [(3, 0)]  # a new run of the query: still in the cooldown
    assert fired("slow", 0.001, 2, 2) == [(2, 3), (3, 0)]  # it is over: what was held back is told
    calls, clock = [], iter([0.0, 3.0, 6.0])
    gate = watch.TriggerGate(lambda b: calls.append(1), clock=lambda: next(clock))
    for i in range(3):
        gate(spark.range(2), i)
    gate(spark.range(0), 9)
    assert len(calls) == 2


def test_reconcile_outcomes(spark):
    state = spark.createDataFrame([(t, "h1", ["h0", "h1"], None) for t in "abcde"], "token_id string, hash string, hashes array<string>, last_checked timestamp")
    rest = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h0"), ("d", "zz"), ("e", "yy")], "token_id string, rest_hash string")
    live = spark.createDataFrame([(t, "bid", 0.5, 1.0) for t in "abcde"], "token_id string, side string, price double, size double")
    fetched = live.where("token_id <> 'b'").unionByName(spark.createDataFrame([("b", "bid", 0.5, 2.0), ("b", "ask", 0.6, 1.0)], live.schema))
    parked = spark.createDataFrame([("e", "yy"), ("d", "old")], "token_id string, parked_hash string")
    out = books.reconcile(state, live, rest, fetched, parked)
    assert rows(out, "token_id", "outcome") == [("a", "agreed"), ("b", "content"), ("c", "ahead"), ("d", "pending"), ("e", "stale")]
    assert books.reconcile_report(out).collect()[0] == (5, 1, 1, 1, 1, 1)
    assert rows(books.still_parked(out)) == [("d", "zz")]
    assert books.divergence_sample(books.level_differences(live, fetched)).count() == 2
    hints = spark.createDataFrame([("e",), ("d",), ("zzz",)], "token_id string")
    assert rows(books.tokens_to_check(state, hints, 3)) == [("a",), ("b",), ("d",)]


def test_frames_of_one_millisecond_follow_their_numbers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [book("t", [(0.3, 5)], [(0.6, 4)], 1000)] + [change("t", "BUY", 0.4, size, 2000) for size in (7, 1, 9, 2)]
    numbered = [f"{k}\t{json.dumps(x)}" for k, x in enumerate(lines)]
    random.Random(1).shuffle(numbered)
    (src / "a.txt").write_text("\n".join(numbered))
    stream = frames.book_events(frames.route_frames(frames.read_frames(spark, str(src))))
    out = run(books.stream_books(stream), "numbered", "update", tmp_path)
    assert [(r.bid, r.ask) for r in out.collect()] == [(0.4, 0.6)]
    events = frames.book_events(frames.route_frames(frames.read_frames(spark, str(src), streaming=False)))
    last = events.where("kind = 'price_change'").orderBy(F.desc("frame_no")).head()
    assert (last.frame_no, last.size) == (4, 2.0)


def test_the_newest_waiting_change_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, line in enumerate([change("t", "BUY", 0.4, 7, 3000), change("t", "BUY", 0.4, 0, 2500), book("t", [(0.3, 5)], [(0.6, 4)], 2000)]):
        (src / f"{k}.txt").write_text(json.dumps(line))
        os.utime(src / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(src))
    landed = lines.select(F.col("value").alias("frame"), F.col("_metadata.file_modification_time").alias("received_at"))
    out = run(books.stream_books(frames.book_events(frames.route_frames(landed))), "waiting", "update", tmp_path)
    assert [r.bid for r in out.where("bid is not null").collect()] == [0.4]


def test_changes_wait_for_a_book_only_so_long(spark, tmp_path):
    """Token t gets its book in time, token u too late: its buffer is gone by then."""
    src = tmp_path / "in"
    src.mkdir()
    steps = [change("t", "BUY", 0.4, 7, 3000), change("u", "BUY", 0.4, 7, 3000), book("t", [(0.3, 5)], [(0.6, 4)], 2000), change("x", "BUY", 0.1, 1, 1), change("x", "BUY", 0.1, 1, 2), book("u", [(0.3, 5)], [(0.6, 4)], 2000)]
    for k, (line, minutes) in enumerate(zip(steps, (0, 1, 20, 200, 201, 202), strict=True)):
        (src / f"{k}.txt").write_text(json.dumps(line))
        os.utime(src / f"{k}.txt", (1_700_000_000 + 60 * minutes,) * 2)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(src))
    landed = lines.select(F.col("value").alias("frame"), F.col("_metadata.file_modification_time").alias("received_at"))
    out = run(books.stream_books(frames.book_events(frames.route_frames(landed)), "1 hour"), "patience", "update", tmp_path)
    assert {r.token_id: (r.bid, r.applied) for r in out.where("bid is not null").collect()} == {"t": (0.4, 1), "u": (0.3, 0)}


def test_counts_of_a_run_equal_counts_of_its_landed_frames(spark, tmp_path):
    r = random.Random(5)
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        lines = ["PONG", "{oops"] + [book("t1", [(0.3, 5)], [(0.6, 4)], 1000 + k, "a")] * (k == 1)
        lines += [change(f"t{r.randint(0, 2)}", "BUY", r.choice([0.2, 0.4, 1.5]), r.choice([0, 7]), 2000 + 10 * k + i) for i in range(20)]
        lines += [{"event_type": "price_change", "market": "m", "price_changes": [{"price": "0.5", "size": "1", "side": "BUY"}]}]
        (src / f"{k}.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        os.utime(src / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(src))
    landed = lines.select(F.col("value").alias("frame"), F.col("_metadata.file_modification_time").alias("received_at"))
    listener = quality.FeedQuality()
    spark.streams.addListener(listener)
    try:
        events = quality.observed_events(frames.book_events(frames.route_frames(landed)))
        out = quality.observed_updates(books.stream_books(events.where("token_id is not null")))
        updates = run(out, "watched", "update", tmp_path)
        until = time.time() + 20
        while not listener.ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    seen = frames.book_events(frames.route_frames(frames.read_frames(spark, str(src), streaming=False)))
    usable = frames.valid_change(F.col("price"), F.col("size"))
    want = seen.agg(
        F.count("*"), F.count_if(F.col("kind") == "book"), F.count_if(F.col("kind") == "price_change"), F.count_if((F.col("kind") == "price_change") & ~usable),
        F.count_if(F.col("ts_ms").isNull()), F.count_if(F.col("token_id").isNull()),
    ).head()
    got = listener.totals[quality.FEED]
    assert tuple(got[k] for k in ("events", "books", "changes", "unusable", "untimed", "nameless")) == tuple(want) and want[3] > 0 and want[5] == 4
    counted = books.stream_quality(updates).head()
    assert all(listener.totals[quality.BOOKS][k] == counted[k] for k in ("applied", "unseeded", "hints")) and counted["applied"] > 0


def test_an_hours_digest_keeps_no_state_in_python(spark, tmp_path):
    """One crowded hour: changes at one time, a late batch, and Spark's own aggregates over all of it."""
    start = datetime(2025, 1, 1, 8)
    steps = [(f"k{i}", start + timedelta(seconds=i % 50), True, False, 0.5 + i / 1000, False, 1.0, "too thin to be worth taking", "implies", 2) for i in range(300)]
    steps += [(f"k{i}", start + timedelta(seconds=i % 50), True, False, 0.1, i % 2 == 0, 1.0, "no order book", "implies", 2) for i in range(300)]
    steps.append(("end", start + timedelta(days=1), False, False, 0.0, False, 1.0, None, "implies", 2))
    df = spark.createDataFrame(
        steps,
        "constraint_key string, check_ts timestamp, violated boolean, unscreenable boolean, magnitude double, confirmed boolean, net_profit double, reason string, kind string, members int",
    ).withColumn("reason", F.col("reason"))
    src = tmp_path / "crowd"
    land(df, src, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    digest = watch.stream_digest(watch.stream_episode_changes(stream), "30 minutes")
    assert digest._jdf.queryExecution().analyzed().toString().count("TransformWithState") == 1
    out = run(digest, "crowd", "append", tmp_path)
    assert [(h, n) for h, _, n, _ in rows(out)] == [(start, 150), (start, 150)]
    assert max(r.worst for r in out.collect()) == 0.5 + 299 / 1000
