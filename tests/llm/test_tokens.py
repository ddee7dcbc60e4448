import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddsgraph.llm import bitpack, packing
from oddsgraph.llm.tokens import Encoder, _same_words, byte_bpe

SF = "/root/testdata/sf0.001"
ODD = [(3, None, "x"), (1, "", "y"), (2, "a  b \n c' s<|endoftext|> ", "z"), (2, "a  b \n c' s<|endoftext|> ", "z"), (7, "long " * 90_000, "q"), (None, "no id", "n"), (5, "Ω漢字😀", "o")]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("generation", [500_000, 3])
def test_encoder_equals_the_tokenizer(plain, monkeypatch, generation):
    monkeypatch.setattr("oddsgraph.llm.tokens.GENERATION", generation)
    rng = random.Random(5)
    bits = [" ", "  ", " \n", "\n ", "a", "é", "　", "\x1c", "\x85", "​", "'s", "'", ".", "5", "²", "漢", "<|endoftext|>", "\t", "😀", "word", " the"]
    codec = Encoder(byte_bpe())
    for _ in range(20):
        some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(50)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)] == [plain(t) for t in some]


def test_a_call_never_walks_the_old_words(plain, monkeypatch):
    """The time of a call follows its own words, not the half million words of the generation before."""
    class Held(dict):
        def __iter__(self):
            raise AssertionError("walked")

    codec = Encoder(byte_bpe())
    codec.encode(["one old word, and more"])
    codec._old, codec._young = Held(codec._young), {}
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(["an old word, and new"])] == [plain("an old word, and new")]
    assert {"old", "word,", "and", "new"} == set(codec._young)


def test_equal_words_have_one_number():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]) - 1)) + b"e" for _ in range(3000)]
    words += [w.rstrip(b"e") + b"\0" for w in words[:500]]
    ends = np.cumsum([len(w) for w in words])
    code, one = _same_words(b"".join(words), np.append(0, ends[:-1]), ends)
    assert len(one) == len(set(words)) == len(set(code.tolist()))
    assert [words[one[k]] for k in code] == words


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = bitpack.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8 and (bitpack.unpack(data, bits, 1001) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError, match="more than"):
            bitpack.pack(np.array([1 << bits]), bits)


def test_sixteen_bits_have_the_general_layout():
    ids = np.arange(1000, dtype="<u4")
    assert bitpack.pack(ids, 16) == np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :16].ravel(), bitorder="little").tobytes()


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_257, 5000).astype("<u4")
    writer = bitpack.ShardWriter(f"{tmp_path}/a/one.bits", bitpack.width(50_257), block=64)
    for k in range(50):
        writer.add(None if k == 7 else k, ids[k * 100 : k * 100 + 100])
    writer.close()
    shard = bitpack.Shard(f"{tmp_path}/a/one.bits")
    for a, b in ((0, 5000), (63, 65), (64, 64), (4990, 5000), (123, 2345)):
        assert (shard.ids(a, b) == ids[a:b]).all()
    assert (shard.document(7) == ids[700:800]).all()
    assert [d for d, _, _ in shard.documents(250)] == [None if k == 7 else k for k in range(50)]


def starts_and_sums(rows, plain):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*plain(text), 0]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_op1_whole_table(spark, plain):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in bitpack.op1_bitpack(spark, SF).collect())
    assert got == starts_and_sums(rows, plain)


def test_op1_odd_rows(spark, plain, tmp_path):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, shard string").withColumn("n_ids", F.lit("mine"))
    got = sorted((tuple(r) for r in bitpack.read_shards(bitpack.write_shards(docs, str(tmp_path), byte_bpe(), 0)).collect()), key=lambda r: r[1])
    rows = sorted(((d, t) for d, t, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == starts_and_sums(rows, plain)
    assert bitpack.read_shards(bitpack.write_shards(docs.limit(0), str(tmp_path), byte_bpe(), 0)).count() == 0


def whole_packing(rows, docs, plain, capacity):
    """Every piece is where it says, sequences are gapless and not overfull."""
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append([*plain(text), 2])
    spans, cover = {}, {}
    for r in rows:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and r.start + r.length <= len(x) for x in ids[r.doc_id])
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cover.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, parts in cover.items():
        assert sum(n for _, _, n in parts) == sum(map(len, ids[doc_id]))
        assert all(n == capacity for piece, _, n in parts if piece > 0)
        if len(ids[doc_id]) == 1:
            assert [p for p, _, _ in sorted(parts)] == list(range(len(parts)))
            assert all(a[1] + a[2] == b[1] for a, b in zip(sorted(parts), sorted(parts)[1:]))
    assert set(cover) == set(ids)
    return len(spans), -(-sum(n for p in spans.values() for _, n in p) // capacity)


def test_op6_whole_table(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used, least = whole_packing(packing.op6_packing(spark, SF).collect(), docs, plain, 1024)
    assert used <= least * 1.03 + 1


def test_op6_odd_rows_and_many_groups(spark, plain, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, piece string").withColumn("fill", F.lit("mine"))
    whole_packing(packing.pack_documents(docs, byte_bpe(), 2, 64).collect(), [(d, t) for d, t, _ in ODD], plain, 64)
    assert packing.pack_documents(docs.limit(0), byte_bpe(), 2).count() == 0
    monkeypatch.setattr(packing, "GROUP", 20)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = whole_packing(
        packing.pack_documents(table, byte_bpe(), 2).collect(), [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], plain, 1024
    )
    assert used <= least * 1.2


def test_sum_of_squares_rule():
    """Each placement has the least sum of squares among open sequences with room."""
    rng, packer = random.Random(3), packing.SumOfSquares(20)
    for _ in range(300):
        size, before = rng.randint(1, 20), packer.counts.copy()

        def after(gap):
            counts = before.copy()
            if gap < 20:
                counts[gap] -= 1
            if gap > size:
                counts[gap - size] += 1
            return (counts**2).sum()

        options = [g for g in range(size, 20) if before[g]] or [20]
        packer.place(size)
        assert (packer.counts**2).sum() == min(map(after, options))


def test_new_words_are_cut_where_the_tokenizer_cuts(plain):
    """Words of letters, marks, digits, contractions and runs of white space, many of them new; only distinct pieces are tokenized."""
    rng = random.Random(11)
    bits = ["a", "B", "é", "ß", "×", "ɏ", "ɐ", "ª", "Ω", "漢", "́", "1", "²", "'", "'s", "'ll", "’", ",", ".", "_", "-", "(", "\n", "\t", "\xa0", "\x1c", "\r\n", " ", "  ", "\0", "word", "<|endoftext|>"]
    codec = Encoder(byte_bpe())
    for _ in range(30):
        some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", " ", "\n"]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(some)] == [plain(t) for t in some]
    seen = []
    tokenize = codec._tokenize
    codec._tokenize = lambda chunks: (seen.extend(chunks), tokenize(chunks))[1]
    codec.encode(["x " + " ".join(f"{a}{b}" for a in ("qwerty", "asdf", "don't") for b in (",", ".", "!", "?\"", "-asdf"))])
    assert sum(len(s) for s in seen) < 60  # the words are 122 characters
