"""Repeated byte strings by a distributed merge sort of suffixes that never re-compares known prefixes.

A string of 400 bytes is anchored where the hash of 32 bytes is smallest within its first
300: equal strings are anchored alike, so only suffixes at anchors have to be sorted, with
the bytes before them at hand. Anchors whose next 132 bytes occur nowhere else, which any
repeated string shares, are left out first by a count of hashes.

Each task sorts its suffixes and front-codes them: the length of the prefix shared with
the suffix before, then the rest. Runs are exchanged by the hash of their first bytes and
merged by loser trees over common prefixes. From the shared prefixes of neighbours and
those of the reversed bytes before, whole classes of equal strings follow for every
offset of the anchor, without touching the texts again.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, drop_cut, read_documents, slices, texts, utf8

LENGTH = 400
SPAN = 300
GRAM = 32
REACH = SPAN - GRAM
"""How far before its anchor a string may begin."""
SURE = LENGTH - REACH
"""Bytes from the anchor on that every string with it holds."""
CROWD = 20_000
"""Documents with an anchor of equal next bytes, beyond which its strings are counted one by one, spread over all tasks."""
PART_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ANCHORS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h", pa.int64()), ("places", pa.list_(pa.int32()))])
_WORK = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int32())), ("context", pa.binary()), ("part", pa.int32()),
     ("n_bytes", pa.int64()), ("sha256", pa.string()), ("body", pa.binary())]
)
_WORK_DDL = "kind int, doc_id long, text_hash long, places array<int>, context binary, part int, n_bytes long, sha256 string, body binary"
DONE, ANCHOR, RUN, TEXT = range(4)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            _powers[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _extreme(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = of(values[:-step], values[step:])
        done += step
    return values


def anchors(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of a text, and the hash of the SURE bytes from each on."""
    n = len(body)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers, back = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    least = _extreme(grams, REACH + 1, np.minimum)[: n - LENGTH + 1]
    # An anchor is the minimum of some string's first bytes; strings begin at 0 to n - LENGTH.
    pad = np.zeros(REACH, np.uint64)
    best = _extreme(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero(grams[: len(best)] == best)
    at = at[at + SURE <= n]
    return at, _mixed((sums[at + SURE] - sums[at]) * back[at]).astype(np.int64)


def find_anchors(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h, places) of all anchors: one row for each document and hash, however often a text repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for a, b in slices(offsets):
                owner, marks, places, sizes = [], [], [], []
                for k in range(a, b):
                    at, h = anchors(data[offsets[k] : offsets[k + 1]])
                    order = np.argsort(h, kind="stable")
                    names, times = np.unique(h, return_counts=True)
                    owner.append(np.full(len(names), k))
                    marks.append(names)
                    places.append(at[order])
                    sizes.append(times)
                of = pa.array(np.concatenate(owner))
                starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(places).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.take(of), hashes.take(of), pa.array(np.concatenate(marks)), lists], schema=_ANCHORS)

    return rows.mapInArrow(run, "doc_id long, text_hash long, h long, places array<int>")


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, from ``start`` on known to agree before."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while True:
        stop = min(n, start + 32)
        if a[start:stop] != b[start:stop]:
            break
        start = stop
    while a[start] == b[start]:
        start += 1
    return start


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix with the string before for each of sorted strings, and all that is left of them."""
    shared = np.zeros(len(strings), np.uint16)
    rest, before = [], b""
    for k, s in enumerate(strings):
        shared[k] = n = shared_prefix(before, s)
        rest.append(s[n:])
        before = s
    return shared, b"".join(rest)


def _decoded(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        stop = at + size - n
        before = before[:n] + rest[at:stop]
        out.append(before)
        at = stop
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, shared) in order: a loser tree whose players carry the prefix they share with the last winner.

    Each run is its sorted strings and their shared prefixes. Of two players the one that
    shares more with the last winner is smaller; bytes are compared only where both share
    as much, and only from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * k
    strings = [runs[r][0] if r < len(runs) else [] for r in range(k)]
    ended = [not s for s in strings]
    shares = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes the one with the winner."""
        if ended[a] or ended[b]:
            return (b, a) if ended[a] else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = strings[a][at[a]], strings[b][at[b]]
        n = shared_prefix(x, y, shares[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while not ended[winner]:
        r = winner
        yield r, at[r], shares[r]
        at[r] += 1
        ended[r] = at[r] == len(strings[r])
        if not ended[r]:
            shares[r] = runs[r][1][at[r]]
        node = (r + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def string_offsets(rights: list[bytes], shared: np.ndarray, lefts: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in sorted order the least and largest offset of a repeated string before it; least > largest: none.

    ``copies`` says how often a suffix with just these bytes around it occurs.
    """
    n = len(rights)
    right, left = np.array([len(r) for r in rights]), np.array([len(x) for x in lefts])
    back = [x[::-1] for x in lefts]
    order = sorted(range(n), key=back.__getitem__)
    common = np.array([0] + [shared_prefix(back[a], back[b]) for a, b in zip(order, order[1:], strict=False)])
    low = np.where(copies > 1, np.maximum(0, LENGTH - right), LENGTH)
    high = np.where(copies > 1, np.minimum(REACH, left), -1)
    place = np.empty(n, np.int64)
    for o in range(REACH + 1):
        valid = np.flatnonzero((right >= LENGTH - o) & (left >= o))
        if len(valid) < 2:
            continue
        place[order] = np.cumsum(common < o)
        names = (np.cumsum(shared < LENGTH - o) * (n + 1) + place)[valid]
        sort = np.argsort(names, kind="stable")
        same = names[sort][1:] == names[sort][:-1]
        twice = np.zeros(len(valid), bool)
        twice[sort[1:][same]] = twice[sort[:-1][same]] = True
        found = valid[twice]
        low[found] = np.minimum(low[found], o)
        high[found] = np.maximum(high[found], o)
    return low, high


def _run_row(part: int, entries: list[tuple[bytes, bytes, bytes, int]], packer: zstandard.ZstdCompressor) -> dict:
    entries.sort()
    rights, lefts, names, copies = zip(*entries, strict=True)
    shared, rest = front_coded(list(rights))
    sizes = np.array([len(r) for r in rights], np.uint16)
    left_sizes = np.array([len(x) for x in lefts], np.uint16)
    head = np.array([len(entries), len(rest)], np.int64).tobytes()
    body = b"".join([head, shared.tobytes(), sizes.tobytes(), left_sizes.tobytes(), np.array(copies, np.int64).tobytes(), *names, rest, *lefts])
    return {"kind": RUN, "part": part, "body": packer.compress(body)}


def _read_run(data: bytes) -> tuple[list[bytes], np.ndarray, list[bytes], list[bytes], np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n, rest_size = np.frombuffer(body, np.int64, 2).tolist()
    at = 16
    shared, sizes, left_sizes = (np.frombuffer(body, np.uint16, n, at + 2 * n * k) for k in range(3))
    at += 6 * n
    copies = np.frombuffer(body, np.int64, n, at)
    at += 8 * n
    names = [body[at + 16 * k : at + 16 * k + 16] for k in range(n)]
    at += 16 * n
    rights = _decoded(shared, sizes, body[at : at + rest_size])
    at += rest_size
    ends = np.cumsum(left_sizes, dtype=np.int64) + at
    lefts = [body[e - s : e] for e, s in zip(ends.tolist(), left_sizes.tolist(), strict=True)]
    return rights, shared, lefts, names, copies


def _contexts(rows: DataFrame, n_parts: int) -> DataFrame:
    """Runs of suffixes with what lies before them, anchors with the name of their context, texts that have any; results of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        entries: dict[bytes, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = defaultdict(list)
            for name, (part, right, left, copies) in entries.items():
                parts[part].append((right, left, name, copies))
            for part, some in parts.items():
                yield _work([_run_row(part, some, packer)])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "places")]
            column, out = batch.column("text"), []
            data, offsets = utf8(column)
            for k, (doc_id, text_hash, places) in enumerate(zip(*columns, strict=True)):
                body = data[offsets[k] : offsets[k + 1]].tobytes()
                if not places:
                    out.append({"kind": DONE, "doc_id": doc_id, "text_hash": text_hash, "n_bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()})
                    continue
                out.append({"kind": TEXT, "doc_id": doc_id, "text_hash": text_hash, "body": packer.compress(body)})
                mine: dict[bytes, list[int]] = {}
                for coded in places:
                    pos, hot = coded >> 1, coded & 1
                    right, left = body[pos : pos + LENGTH], body[max(0, pos - REACH) : pos]
                    name = xxhash.xxh3_128_digest(right + len(left).to_bytes(2, "little") + left)
                    mine.setdefault(name, []).append(pos)
                    if name in entries:
                        entries[name][3] += 1
                        continue
                    part = -1 if hot else xxhash.xxh3_64_intdigest(right[:SURE]) % n_parts
                    entries[name] = [part, right, left, 1]
                    held += len(right) + len(left)
                out += [{"kind": ANCHOR, "doc_id": doc_id, "text_hash": text_hash, "places": at, "context": name} for name, at in mine.items()]
                if len(out) > 5000:
                    yield _work(out)
                    out = []
                if held > 32 << 20:
                    yield from flush()
                    entries, held = {}, 0
            if out:
                yield _work(out)
        yield from flush()

    return rows.mapInArrow(run, _WORK_DDL)


def _work(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_WORK)


_FOUND = pa.schema([("context", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
_FOUND_DDL = "context binary, low int, high int"


def _merged(table: pa.Table) -> pa.Table:
    """Offsets of the repeated strings of all contexts of a part."""
    runs = [_read_run(b.as_py()) for b in table.column("body")]
    rights, shared, lefts, names, copies = [], [], [], [], []
    seen: dict[bytes, int] = {}
    owed = LENGTH
    for r, k, common in merge_runs([(x[0], x[1].tolist()) for x in runs]):
        name, times = runs[r][3][k], int(runs[r][4][k])
        owed = min(owed, common)
        if name in seen:
            copies[seen[name]] += times
            continue
        seen[name] = len(names)
        rights.append(runs[r][0][k])
        shared.append(owed if names else 0)
        lefts.append(runs[r][2][k])
        names.append(name)
        copies.append(times)
        owed = LENGTH
    low, high = string_offsets(rights, np.array(shared), lefts, np.array(copies))
    some = low <= high
    return pa.Table.from_arrays([pa.array([n for n, s in zip(names, some, strict=True) if s], pa.binary()), pa.array(low[some].astype(np.int32)), pa.array(high[some].astype(np.int32))], schema=_FOUND)


def _strings_of(runs: DataFrame) -> DataFrame:
    """(string, context, offset, copies) of every string around anchors in a crowd, each named by its 128-bit hash."""
    schema = pa.schema([("string", pa.binary()), ("context", pa.binary()), ("offset", pa.int32()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("body"):
                rights, _, lefts, names, copies = _read_run(data.as_py())
                for right, left, name, times in zip(rights, lefts, names, copies.tolist(), strict=True):
                    offsets = range(max(0, LENGTH - len(right)), min(REACH, len(left)) + 1)
                    whole, n = left + right, len(left)
                    found = [xxhash.xxh3_128_digest(whole[n - o : n - o + LENGTH]) for o in offsets]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([name] * len(found), pa.binary()), pa.array(list(offsets), pa.int32()), pa.array([times] * len(found), pa.int64())], schema=schema)

    return runs.select("body").mapInArrow(run, "string binary, context binary, offset int, copies long")


def repeated_offsets(runs: DataFrame) -> DataFrame:
    """(context, low, high): a string repeats that begins ``low`` and one that begins ``high`` bytes before the anchor."""
    sorted_ = runs.where("part >= 0").select("part", "body").groupBy("part").applyInArrow(_merged, _FOUND_DDL)
    strings = _strings_of(runs.where("part < 0"))
    # One string may be met from two anchors inside it, but from each at another offset.
    twice = strings.groupBy("string", "offset").agg(F.sum("copies").alias("n")).where("n > 1").select("string", "offset")
    crowd = strings.join(twice, ["string", "offset"], "left_semi").groupBy("context").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    return sorted_.union(crowd)


def kept(body: bytes, places: list[dict]) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, what is left) of a text, from (places, low, high) of its anchors."""
    spans = sorted((at - p["high"], at - p["low"] + LENGTH) for p in places for at in p["places"])
    out, at, removed, n = [], 0, 0, 0
    for start, stop in spans:
        if start > at or not n and start == 0:
            out.append(body[at:start])
            n += 1
            at = start
        if stop > at:
            removed += stop - at
            at = stop
    out.append(body[at:])
    return removed, n, b"".join(out)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finished(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                body = unpacker.decompress(row["body"])
                removed, n, rest = kept(body, row["places"] or [])
                out.append({"doc_id": row["doc_id"], "n_bytes": len(body), "n_removed": removed, "n_spans": n, "kept_sha256": hashlib.sha256(rest).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    return rows.mapInArrow(run, _RESULT_DDL)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every byte covered by a repeated 400-byte string removed.

    Texts are judged as they come in, as UTF-8 bytes; strings never cross documents.
    Null and empty texts have no bytes. Repeated rows repeat each other. Rows are known by
    doc_id and the hash of their text, so a null doc_id is no special case.
    """
    rows = texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = cut(find_anchors(rows))
    counts = found.groupBy("h").agg(F.sum(F.size("places")).alias("n"), F.count("*").alias("documents")).where("n > 1")
    # A place and whether it stands in a crowd as one number; repeated rows list each place more than once.
    crowded = (F.col("documents") > CROWD).cast("int")
    coded = F.transform("places", lambda p: p * 2 + F.col("crowded"))
    places = found.join(counts.select("h", crowded.alias("crowded")), "h").select("doc_id", "text_hash", coded.alias("places"))
    places = places.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).agg(F.flatten(F.collect_list("places")).alias("places"))
    places = cut(places.select("i", "t", F.sort_array(F.array_distinct("places")).alias("places")))
    drop_cut(found)
    n_parts = max(1, math.ceil(places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).head()[0] * (LENGTH + REACH) / PART_BYTES))
    both = rows.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    work = cut(_contexts(both.select("doc_id", "text_hash", "text", "places"), n_parts))
    offsets = cut(repeated_offsets(work.where(F.col("kind") == RUN)))
    spans = work.where(F.col("kind") == ANCHOR).select("doc_id", "text_hash", F.col("places").alias("at"), "context").join(offsets, "context")
    spans = spans.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct(F.col("at").alias("places"), "low", "high")).alias("places"))
    bodies = work.where(F.col("kind") == TEXT).select("doc_id", "text_hash", "body")
    touched = bodies.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    done = work.where(F.col("kind") == DONE).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return done.union(_finished(touched.select("doc_id", "body", "places")))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))
