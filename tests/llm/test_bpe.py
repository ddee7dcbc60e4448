import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from oddsgraph.llm import bpe
from oddsgraph.llm.common import read_documents

SF = "/root/testdata/sf0.001"
ODD = [
    (3, None, "x"), (1, "", "y"), (2, "It's  THEY'LL\n\t go.<|endoftext|> İΣΑΣ", "z"), (2, "It's  THEY'LL\n\t go.<|endoftext|> İΣΑΣ", "z"),
    (7, "long " * 300_000, "q"), (8, "unbroken" * 40_000, "q"), (None, "no id", "n"), (5, "Ω漢字😀 éी Ᲊ", "o"), (9, " ", "b"),
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.word_bpe())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(bpe.word_bpe())


def ids_of(model, bodies):
    ids, ends = model.encode(bodies)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("chunks", "piece"), [(600_000, 1 << 20), (4, 7)])
def test_encoder_equals_the_library(library, monkeypatch, chunks, piece):
    monkeypatch.setattr(bpe, "MOST_CHUNKS", chunks)
    monkeypatch.setattr(bpe, "PIECE", piece)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "a", "é", "é", "　", "\x1c", "\x85", "​", "'s", "'LL", ".", "5", "²", "漢", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "😀", "Word", "Σ", "İ", "ͅ", "Ᲊ", "\U000104d6"]
    own = bpe.Bpe(bpe.word_bpe())
    for _ in range(20):
        some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(50)]
        assert ids_of(own, some) == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_characters_taken_without_the_library(model):
    bounds = bpe.AGREED.replace("\\x00", "\0")
    runs, k = [], 0
    while k < len(bounds):
        wide = bounds[k + 1 : k + 2] == "-"
        runs.append((ord(bounds[k]), ord(bounds[k + 2] if wide else bounds[k])))
        k += 3 if wide else 1
    for first, last in runs:
        for c in range(first, last + 1):
            text = f"A{chr(c)}1{chr(c)}́{chr(c)}"
            assert model._plain_words(text) == model._by_library(text), hex(c)


def test_merges_equal_repeated_search_for_the_lowest_rank(model):
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice("aehilnorst") for _ in range(rng.randint(1, 14)))
        parts = [model.inner[b] for b in word.encode()]
        parts[-1] = model.last[word.encode()[-1]]
        while found := [(model.rank[key], k) for k in range(len(parts) - 1) if (key := parts[k] * model.size + parts[k + 1]) in model.rank]:
            rank, k = min(found)
            parts[k : k + 2] = [model.made[rank]]
        assert model.merge(word) == parts


def test_decoding(spark, library):
    some = [(1, [0, 49407, 300, 49406]), (2, []), (3, None), (4, [5, -1, None, 49408, 6])]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(some, "doc_id long, ids array<int>"), bpe.word_bpe()).collect()}
    assert got == {1: library.decode(some[0][1], skip_special_tokens=False), 2: "", 3: None, 4: library.decode([5, 6], skip_special_tokens=False)}


def test_odd_rows_and_clashing_columns(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit(1)).repartition(3)
    got = sorted(((r.doc_id, r.ids, r.text) for r in bpe.decode(bpe.encode(docs, bpe.word_bpe()), bpe.word_bpe()).collect()), key=str)
    want = [(k, e.ids, library.decode(e.ids, skip_special_tokens=False)) for k, t, _ in ODD for e in [library.encode(t or "", add_special_tokens=False)]]
    assert got == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), bpe.word_bpe()).collect() == []


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op11_bpe(spark, SF).collect()}
    docs = read_documents(spark, SF).collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert got[row.doc_id] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_schema(spark):
    assert bpe.op11_bpe(spark, SF).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert bpe.encode(spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])), bpe.word_bpe()).count() == 0
