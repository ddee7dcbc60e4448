import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from oddsgraph.llm import secrets

SF = "/root/testdata/sf0.01"


def by_hand(text):
    """The three patterns as they are given, failing matches dropped afterwards."""
    found = []
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([letters(w) for w in ("password", "passwd", "secret", "token")] + [letters("api") + "_?" + letters("key")])
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def noise(rng):
    bits = ["token", "TOKEN", "Secret", "passwd", "api_key", "apiKEY", "=", ":", " ", '"', "'", "token:token :abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "é", "\n", "x", "password=", "ſecret", "abc/+._-="]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    for _ in range(4000):
        text = noise(rng)
        base, spans, _ = secrets.scan(text)
        assert secrets.listed(base) == by_hand(text)
        assert set(base) <= set(spans)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op9_secrets(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = by_hand(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
    assert sum(r.n_assign for r in got) > 0


def hidden(text):
    return secrets.redact(text, secrets.scan(text)[2], "#")


def test_lexer_follows_names():
    assert hidden('const K = "aB3$kd93jdkLQ0"\nDB_PASSWORD = K') == 'const K = "#"\nDB_PASSWORD = K'
    assert hidden("base: hunter2hunter9\npassphrase: ${base}") == "base: #\npassphrase: ${base}"
    assert hidden('p1="abcD12";p2="efgH34";secret_key = p1 + p2') == 'p1="#";p2="#";secret_key = p1 + p2'
    assert hidden("<auth_token>abc123XYZ789</auth_token>") == "<auth_token>#</auth_token>"
    assert hidden("run --api-key zzTop12345") == "run --api-key #"
    assert hidden('{"client_secret": "s3cr3t-XyZ-123"}') == '{"client_secret": "#"}'
    for harmless in ("a=${b}\nb=${a}\npwd=${a}", "token_id: 1234567", "the key: of the matter", '"password": null', "pwd: changeme", 'color = "aB3$kd93jdkLQ0"', ""):
        assert hidden(harmless) == harmless


def test_odd_rows_and_hiding(spark):
    secret = "é token = 'abcdef123456' end"
    rows = [(1, None, None, "x"), (2, "", 0, "y"), (3, secret, 99, "z"), (3, secret, 99, "z"), (None, "AKIA" + "A" * 16, 20, "n"), (5, "plain", 77, "p"), (6, "w " * 200_000 + "0f" * 12, None, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string").withColumn("n_hex", F.lit(True))
    got = {(r.doc_id, r.spans) for r in secrets.find_secrets(docs).collect()}
    assert got == {(1, ""), (2, ""), (3, "assign:2:23"), (None, "access:0:20"), (5, ""), (6, "hex:400000:400024")}
    assert secrets.find_secrets(docs).count() == len(rows)
    clean = secrets.hide_secrets(docs)
    assert clean.columns == docs.columns
    out = {(r.doc_id, r.text if r.doc_id != 6 else r.text[-10:], r.n_chars) for r in clean.collect()}
    assert out == {(1, None, None), (2, "", 0), (3, "é token = '[SECRET]' end", 24), (None, "[SECRET]", 8), (5, "plain", 77), (6, "w [SECRET]", 400_008)}
    assert secrets.hide_secrets(docs.limit(0)).count() == 0 and secrets.find_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [*secrets.STRONG, *secrets.WEAK, "connection_string", "Pass-Word", "to.ken", "my.pin"])
def test_each_name_alone_is_enough(name):
    value = "f3Kq9XbT7mW2pLz8"
    text = f'zzz {name.upper()} = "{value}" zzz'
    at = text.index(value)
    assert (at, at + len(value)) in secrets.scan(text)[2]


@pytest.mark.parametrize("form", ["{} = '{}'", "--{} {}", "<{}>{}</x>"])
def test_names_of_any_length(form):
    name, value = "a" + "-bcdefgh" * 5_000 + "-session", "f3Kq9XbT7mW2pLz8"
    text = form.format(name, value)
    at = text.index(value)
    assert secrets.scan(text)[2] == [(at, at + len(value))]


def test_names_assigned_to_themselves_take_linear_time():
    text = "token = token\n" * 100_000 + 'token = "f3Kq9XbT7mW2pLz8Vd4"\n'
    start = time.process_time()
    spans = secrets.lexed_spans(text)
    assert time.process_time() - start < 30
    assert [text[a:b] for _, a, b in spans] == ["f3Kq9XbT7mW2pLz8Vd4"]


def test_weights_equal_a_walk_from_every_name():
    """A literal's weight is the best of all sensitive names that reach it, over circles too."""
    rng = random.Random(5)
    names = ["db_password", "auth", "alpha", "beta", "gamma", "delta"]
    for _ in range(200):
        pairs = []
        for k in range(rng.randint(1, 9)):
            value = rng.choice(names) if rng.random() < 0.6 else '"' + rng.choice(["Kq9XbT7m", "aBcD1234efGh", "zzz9Yx8w7V6u"]) + str(k) + '"'
            pairs.append((rng.choice(names), value))
        text = "".join(f"{n} = {v}\n" for n, v in pairs)
        want = set()
        for name, _ in pairs:
            weight, seen, waiting = secrets.name_score(name), set(), [name]
            while weight and waiting:
                for n, v in pairs:
                    if n == waiting[-1] and v in names and v not in seen:
                        seen.add(v)
                        waiting.insert(0, v)
                reached = waiting.pop()
                under = {v.strip('"') for n, v in pairs if n == reached} - {n for n, _ in pairs}  # a name without a value is a literal
                want |= {v for v in under if weight + secrets.literal_score(v) >= secrets.THRESHOLD}
        assert {text[a:b] for _, a, b in secrets.lexed_spans(text)} == want
