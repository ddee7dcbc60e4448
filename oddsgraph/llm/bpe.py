"""BPE encoding and decoding (operator 11): merges by a priority queue over a doubly linked list of symbols.

A text is split into words as the tokenizer file says. Each word starts as a linked list of
its bytes; a heap holds the merges its neighbours allow, lowest rank first, then leftmost. A
merge unlinks its right symbol and pushes the two pairs it makes; entries whose pair is no
longer there are skipped when they come up. A word of n bytes takes n log n steps, so one
unbroken run of a million letters is no trouble. No word goes across a space, so a text is
looked up in chunks between spaces; each chunk and word is worked on once while it stays in a
worker's cache of bounded size. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.llm.common import SLICE_BYTES, read_documents, slices, texts, utf8

WORD_BPE = "word_bpe_49k.json"
MOST_CHUNKS = 400_000
"""Chunks between spaces that a worker keeps; beyond them its cache starts anew."""
PIECE = 1 << 20
"""Characters of a text in hand at once."""

# The word pattern of the file, its white space, and characters on whose class,
# case and composition this Python's tables and the tokenizer's agree (the tests go through them).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
AGREED = "\\x00-\u052f\u1e00-\u1fff\u2000-\u2070\u2090-\u209c\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u309b-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uffbe\U0001f300-\U0001f64f"
_AGREED = regex.compile(f"[{AGREED}]*+")

IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.large_string())])


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _described(path: str) -> dict:
    with open(path, encoding="utf-8") as source:
        return json.load(source)


class Vocabulary:
    """The strings of a tokenizer file by id, and what stands between them in a decoded text."""

    def __init__(self, described: dict) -> None:
        vocabulary, added = described["model"]["vocab"], described["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.strings: list[str | None] = [None] * self.size
        for token, k in [*vocabulary.items(), *self.special.items()]:
            self.strings[k] = token
        self.joint = "" if described["decoder"] else " "


class Bpe(Vocabulary):
    """Words, merges and vocabulary of a tokenizer file with byte symbols and word ends."""

    def __init__(self, path: str) -> None:
        described = _described(path)
        super().__init__(described)
        model, vocabulary = described["model"], described["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.path = path
        # Merged pairs as one number: left * size + right.
        self.made: list[int] = []
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.made.append(vocabulary[left + right])
            self.rank[vocabulary[left] * self.size + vocabulary[right]] = rank
        symbols = byte_symbols()
        self.inner = [vocabulary[s] for s in symbols]
        self.last = [vocabulary[s + end] for s in symbols]
        found = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self._library = None
        self.forget()

    def forget(self) -> None:
        self._index: dict[str, int] = {"": 0}
        self._ids, self._starts, self._letters = array("i"), array("q", [0, 0]), 0
        self._merged: dict[str, array] = {}

    def _keep(self, chunk: str) -> None:
        self._index[chunk] = len(self._starts) - 1
        self._letters += len(chunk)
        for word in self.words(chunk):
            ids = self._merged.get(word)
            if ids is None:
                self._merged[word] = ids = array("i", self.merge(word) if word[0] != " " else [self.special[word[1:]]])
            self._ids += ids
        self._starts.append(len(self._ids))

    def merge(self, word: str) -> list[int]:
        """The ids of one word. A queue entry is one number: rank * length + place of the left symbol."""
        data = word.encode("utf-8", "surrogatepass")
        n, size, made, ranks = len(data), self.size, self.made, self.rank.get
        symbols = [*map(self.inner.__getitem__, data)]
        symbols[-1] = self.last[data[-1]]
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        queue = []
        for at in range(n - 1):
            rank = ranks(symbols[at] * size + symbols[at + 1])
            if rank is not None:
                queue.append(rank * n + at)
        heapify(queue)
        while queue:
            rank, at = divmod(heappop(queue), n)
            right, left = after[at], before[at]
            # Stale: the symbol was merged away, is the last one, or has another neighbour by now.
            if symbols[at] < 0 or right == n or ranks(symbols[at] * size + symbols[right]) != rank:
                continue
            symbols[at] = symbol = made[rank]
            symbols[right] = -1
            after[at] = follows = after[right]
            if follows < n:
                before[follows] = at
                if (next_rank := ranks(symbol * size + symbols[follows])) is not None:
                    heappush(queue, next_rank * n + at)
            if left >= 0 and (next_rank := ranks(symbols[left] * size + symbol)) is not None:
                heappush(queue, next_rank * n + left)
        return [s for s in symbols if s >= 0]

    def _by_library(self, text: str) -> list[str]:
        """Words of a text with characters on which Unicode tables of different years differ."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            tokenizer = Tokenizer.from_file(self.path)
            first = _described(self.path)["pre_tokenizer"]["pretokenizers"][0]
            split = pre_tokenizers.Split(Regex(first["pattern"]["Regex"]), first["behavior"].lower(), first["invert"])
            self._library = tokenizer.normalizer.normalize_str, split.pre_tokenize_str
        normalize, split = self._library
        return [word for word, _ in split(normalize(text))]

    def _plain_words(self, text: str) -> list[str]:
        if _AGREED.fullmatch(text) is None:
            return self._by_library(text)
        if not text.isascii():
            # Each letter falls by itself: no special form for a sigma that ends a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _WORD.findall(text.lower())

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is its string after a space."""
        if self._special is None or not self._special.search(text):
            return self._plain_words(text)
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            out += [" " + part] if k % 2 else self._plain_words(part)
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut at spaces, where no word and no composed character goes on."""
        at = 0
        while len(text) - at > PIECE and (stop := text.find(" ", at + PIECE)) >= 0:
            yield text[at:stop]
            at = stop + 1
        yield text[at:]

    def _look_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks between spaces one after another, and how many each has."""
        if len(self._index) > MOST_CHUNKS or self._letters > 16 * MOST_CHUNKS:
            self.forget()
        for chunk in set(chunks).difference(self._index):
            self._keep(chunk)
        places = np.fromiter(map(self._index.__getitem__, chunks), np.int64, len(chunks))
        starts, ids = np.frombuffer(self._starts, np.int64), np.frombuffer(self._ids, np.int32) if self._ids else np.zeros(0, np.int32)
        first = starts[places]
        length = starts[places + 1] - first
        before = np.cumsum(length) - length
        return ids[np.repeat(first - before, length) + np.arange(int(length.sum()))], length

    def encode(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        parts, lengths, counts = [], [], []
        waiting: list[str] = []
        for body in bodies:
            n = 0
            for piece in self._pieces(body):
                found = piece.split(" ")
                n += len(found)
                waiting += found
                if len(waiting) > PIECE:
                    ids, length = self._look_up(waiting)
                    parts.append(ids)
                    lengths.append(length)
                    waiting = []
            counts.append(n)
        ids, length = self._look_up(waiting)
        each = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, length]))])
        ends = each[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        return np.concatenate([*parts, ids]), ends


@lru_cache(maxsize=1)
def bpe(path: str) -> Bpe:
    """One for a worker process."""
    return Bpe(path)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(_described(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = bpe(path)
    for batch in batches:
        for a, b in slices(utf8(batch.column("text"))[1], SLICE_BYTES):
            ids, ends = model.encode(batch.column("text").slice(a, b - a).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], schema=IDS)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = vocabulary(path)
    strings, joint = pa.array([*model.strings, None], pa.large_string()), pa.scalar(model.joint, pa.large_string())
    for batch in batches:
        column = batch.column("ids")
        for a, b in slices(np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())]), SLICE_BYTES):
            lists = column.slice(a, b - a)
            ids = lists.flatten()
            known = pc.and_kleene(pc.greater_equal(ids, 0), pc.less(ids, model.size)).fill_null(False)
            tokens = strings.take(pc.if_else(known, ids, model.size))
            owner = pc.list_parent_indices(lists).filter(tokens.is_valid())
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner.to_numpy(), minlength=b - a))])
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens.drop_null(), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pc.binary_join(whole, joint)], schema=DECODED)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text under the tokenizer file at ``path``, in order.

    One row for each row, so repeated rows, null and equal ids stay as they are. A null text
    counts as empty and has no ids; texts of any length are encoded whole. Strings of special
    tokens become their ids, as by default in the library. No other column of ``docs`` is read.
    """
    return texts(docs).mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the vocabulary's strings of ``ids`` put together, special tokens included.

    Between strings stands a space where the file names no decoder, as in the library. Null
    ids give a null text, no ids an empty one; numbers outside the vocabulary and nulls among
    the ids are passed over.
    """
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        partial(_decode, path=path), "doc_id long, ids array<int>, text string"
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to.

    One row for each row of ``documents``; null and empty texts have no ids and decode to ''.
    """
    path = word_bpe()
    return decode(encode(read_documents(spark, sf_dir), path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
