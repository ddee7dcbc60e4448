"""Whole texts to token ids with a public tokenizer file; each word is tokenized once while it is cached."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers

BYTE_BPE = "byte_bpe_50k.json"
GENERATION = 100_000
"""Words in each of the two cache generations of a worker."""
LONGEST_KEPT = 48
AT_ONCE_BYTES = 4 << 20
"""Text handed to ``encode`` at a call: the more, the fewer distinct words to look up."""
_AT_ONCE = 64
_SPACE, _APOSTROPHE = 32, 39
_ALPHA = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_OTHER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_ENDS = _OTHER & (np.arange(256) != _SPACE) & (np.arange(256) != _APOSTROPHE)
"""What may stand before a letter and is sure to be cut from it."""
_VISIBLE = np.array([not chr(c).isspace() for c in range(128)] + [True] * 128)
_WIDE_BLANKS = np.array([int.from_bytes(c.encode()[:3].ljust(3, b"\0")) for c in map(chr, range(128, 0x3001)) if c.isspace()])
"""White space beyond ASCII as three bytes, the last 0 where it has two."""
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    A byte-level tokenizer never merges across a space that a visible character follows,
    so texts are cut there and each word goes through the tokenizer once while it stays
    in the cache. The words of a call are numbered as whole arrays, so that only distinct ones
    become Python strings, and ids are put together by one gather. New words are cut between letters and
    other characters where the tokenizer is sure to, and only distinct pieces of them are tokenized.
    The cache holds two generations of bounded size; very long words are never kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._opens = np.zeros(self.vocabulary, bool)  # tokens that begin with a space
        self._opens[[k for token, k in self.tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _tokenize(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _tokenize_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces that begin with their only space; many at a call, told apart by the tokens that begin with one."""
        out: list[bytes] = []
        groups = [words[k : k + _AT_ONCE] for k in range(0, len(words), _AT_ONCE)]
        for group, data in zip(groups, self._tokenize([b"".join(g).decode() for g in groups]), strict=True):
            places = (np.flatnonzero(self._opens[np.frombuffer(data, np.uint32)]) * 4).tolist()
            if len(places) == len(group):
                out += [data[a:b] for a, b in zip(places, [*places[1:], len(data)], strict=True)]
            else:
                out += self._tokenize([w.decode() for w in group])
        return out

    def _learn(self, words: list[str], ids: list[bytes | None], body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Fill ``ids`` for the distinct words that the young generation lacks, and bring these into it.

        Each lies in ``body`` from the space before it on.
        """
        missing = new = [k for k, x in enumerate(ids) if x is None]
        if self._old:
            for k, x in zip(missing, map(self._old.get, map(words.__getitem__, missing)), strict=True):
                ids[k] = x
            new = [k for k in missing if ids[k] is None]
        if new:
            places = np.array(new)
            size = ends[places] - starts[places]
            edges = np.concatenate([[0], np.cumsum(size)])
            data = body[np.repeat(starts[places] - edges[:-1], size) + np.arange(edges[-1])].tobytes()
            cuts = _letter_cuts(data, edges)
            stops = np.append(cuts[1:], len(data))
            code, one = _same_words(data, cuts, stops)
            pieces = [data[a:b] for a, b in zip(cuts[one].tolist(), stops[one].tolist(), strict=True)]
            alone = [p.rfind(b" ") == 0 and p != b" " for p in pieces]
            led = iter(self._tokenize_words([p for p, x in zip(pieces, alone, strict=True) if x]))
            rest = iter(self._tokenize([p.decode() for p, x in zip(pieces, alone, strict=True) if not x]))
            out, after = _gather([next(led if x else rest) for x in alone], code)
            bounds = (after[np.searchsorted(cuts, edges)] * 4).tolist()
            for k, a, b in zip(new, bounds, bounds[1:]):
                ids[k] = out[a:b]
        kept = [k for k in missing if len(words[k]) <= LONGEST_KEPT]
        self._young.update(zip(map(words.__getitem__, kept), map(ids.__getitem__, kept), strict=True))

    def encode(self, bodies: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts = [body.encode() for body in bodies]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        data = b"".join(parts)
        cuts = _cuts(data, edges)
        first = np.searchsorted(cuts, edges)  # of each text
        stops = np.append(cuts, len(data))
        heads = [data[a:b].decode() for a, b in zip(edges[:-1].tolist(), np.minimum(stops[first[:-1]], edges[1:]).tolist(), strict=True)]
        ends = stops[1:].copy()
        filled = np.flatnonzero(first[1:] > first[:-1])
        ends[first[filled + 1] - 1] = edges[filled + 1]
        code, one = _same_words(data, cuts + 1, ends)
        words = [data[a:b].decode() for a, b in zip((cuts[one] + 1).tolist(), ends[one].tolist(), strict=True)]
        ids = list(map(self._young.get, words))
        self._learn(words, ids, np.frombuffer(data, np.uint8), cuts[one], ends[one])
        ids += self._tokenize(heads)
        out, after = _gather(ids, np.insert(code, first[:-1], np.arange(len(words), len(ids))))
        if len(self._young) > GENERATION:
            self._old, self._young = self._young, {}
        bounds = (after[first + np.arange(len(first))] * 4).tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]


def _gather(ids: list[bytes], order: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``ids`` put together in ``order``, and the number of ids before each place and after the last."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    length = sizes[order]
    after = np.concatenate([[0], np.cumsum(length)])
    kind = np.int32 if max(after[-1], sizes.sum()) < 1 << 31 else np.int64  # half the memory
    place = np.repeat(((np.cumsum(sizes) - sizes)[order] - after[:-1]).astype(kind), length)
    place += np.arange(after[-1], dtype=kind)
    return np.frombuffer(b"".join(ids), "<u4")[place].tobytes(), after


def _cuts(data: bytes, edges: np.ndarray) -> np.ndarray:
    """Places of the spaces that a visible character of the same text follows."""
    body = np.frombuffer(data + bytes(4), np.uint8)
    cuts = np.flatnonzero(body[: len(data)] == 32)
    cuts = cuts[_VISIBLE[body[cuts + 1]]]
    if len(wide := np.flatnonzero(body[cuts + 1] >= 0xC2)):
        a, b, c = (body[cuts[wide] + k].astype(np.int64) for k in (1, 2, 3))
        blank = np.isin((a << 16) + (b << 8) + np.where(a >= 0xE0, c, 0), _WIDE_BLANKS)
        cuts = np.delete(cuts, wide[blank])
    last = edges[1:][np.diff(edges) > 0] - 1
    return cuts[~np.isin(cuts, last)]


def _letter_cuts(data: bytes, edges: np.ndarray) -> np.ndarray:
    """Where pieces of words begin: at each word, and between letters and ASCII characters that are
    none, where the tokenizer is sure to cut.

    It isn't after a space or an apostrophe (as in ``'s``), where white space runs on, or
    beyond ASCII, where more letters might follow.
    """
    body = np.frombuffer(data + b"\0", np.uint8)
    n = len(data)
    letter = _ALPHA[body[:n]]
    if len(lead := np.flatnonzero((body[:n] >= 0xC3) & (body[:n] <= 0xC9))):  # À to ɏ but × and ÷
        one, two = body[lead], body[lead + 1]
        latin = lead[np.where(one == 0xC3, (two != 0x97) & (two != 0xB7), (one < 0xC9) | (two <= 0x8F))]
        letter[latin] = letter[latin + 1] = True
    begins = np.zeros(n, bool)
    begins[1:] = letter[:-1] & _OTHER[body[1:n]]
    opens = np.flatnonzero(letter[1:] & _ENDS[body[: n - 1]]) + 1
    before = body[np.maximum(opens - 2, 0)]
    begins[opens[_VISIBLE[body[opens - 1]] | _VISIBLE[before] & (before < 128)]] = True
    begins[edges[:-1]] = True
    return np.flatnonzero(begins)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, equal for equal keys, and a place of each number."""
    found = pa.array(keys).dictionary_encode()
    code, one = found.indices.to_numpy(), np.empty(len(found.dictionary), np.int64)
    one[code] = np.arange(len(code))
    return code, one


def _same_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal bytes, and a place of each number.

    Words of up to 16 bytes are compared as one or two whole numbers, others one by one.
    """
    room = data + bytes(16)
    eight = np.ndarray((len(data) + 9,), "<u8", room, strides=(1,))
    n = ends - starts
    long = n > 16
    if 0 in data:  # it would pass for the end of a word
        holds = np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, np.uint8) == 0), "right") - 1
        long[holds[holds >= 0]] = True
    code, ones, count = np.zeros(len(n), np.int64), [], 0
    short, middle = np.flatnonzero((n <= 8) & ~long), np.flatnonzero((n > 8) & ~long)
    both = np.zeros(0, np.int64)
    if len(middle):
        lead, _ = _numbered(eight[starts[middle]])
        tail, tails = _numbered(eight[starts[middle] + 8] & _MASKS[n[middle] - 8])
        both = lead.astype(np.int64) * len(tails) + tail
    for at, keys in ((short, eight[starts[short]] & _MASKS[n[short]]), (middle, both)):
        which, one = _numbered(keys)
        code[at] = which + count
        ones.append(at[one])
        count += len(one)
    seen: dict[bytes, int] = {}
    places = np.flatnonzero(long)
    for k, a, b in zip(places.tolist(), starts[places].tolist(), ends[places].tolist(), strict=True):
        word = data[a:b]
        if word not in seen:
            seen[word] = count + len(seen)
            ones.append(np.array([k]))
        code[k] = seen[word]
    return code, np.concatenate(ones)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)


def byte_bpe() -> str:
    return public_tokenizers.path(BYTE_BPE)
