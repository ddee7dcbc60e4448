"""Secrets in texts: three fixed patterns, and a lexer that knows what a literal is assigned to.

The lexer reads assignments of source and configuration syntax (``name = "x"``,
``name: x``, ``"name": "x"``, ``name => 'x'``, ``export NAME=x``, ``--name x``,
``<name>x</name>``), joins concatenated literals and follows names that were given a
constant, also through ``${name}``. A literal is scored by the names it ends up under and
by its own looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from oddsgraph.llm.common import over_slices, read_documents, slices, texts, utf8

# The base patterns, by kind in the order of report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run, so the same as runs of any length of which the short ones are dropped
KINDS = ["assign", "access", "hex", "literal"]
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
_BASE_NAMES = ("password", "passwd", "secret", "token", "api")

# Parts of names that hold secrets and their weight, and literals that are none.
STRONG = ("password", "passwd", "passphrase", "passwort", "pwd", "secret", "token", "apikey", "privatekey", "accesskey", "credential", "bearer")
WEAK = ("auth", "key", "pass", "pin", "salt", "signature", "cookie", "session", "dsn", "connectionstring")
PLAIN = {"true", "false", "null", "none", "nil", "undefined", "changeme", "change_me", "example", "placeholder", "redacted", "required", "optional", "string", "todo", "tbd", "your_password", "yourpassword", "your_token"}
THRESHOLD = 3.0
LEAST_LITERAL = 6

_HEAD = re.compile(
    r"""(?<![A-Za-z0-9_.$-])(?:
        (?P<quote>["']?)(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)(?P=quote)[ \t]*(?::=|=>|=(?![=>])|:(?![:=]))[ \t]*
      | --(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)(?:=|[ ]+)
      | <(?P<tag>[A-Za-z_][A-Za-z0-9_.-]*+)>
    )""",
    re.VERBOSE,
)
_TERM = re.compile(
    r"""(?: (?P<mark>["'`])(?P<quoted>(?:\\.|(?!(?P=mark))[^\\\n])*)(?P=mark)
      | \$\{(?P<braced>[A-Za-z_][A-Za-z0-9_.-]*)\}
      | (?P<bare>[A-Za-z0-9_+/=.$@!%^&*~:-]+) )""",
    re.VERBOSE,
)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\|)[ \t]*(?=[\"'`$A-Za-z_])")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*")

Span = tuple[str, int, int]
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())]
)


def base_spans(text: str) -> list[tuple[Span, tuple[int, int]]]:
    """Every base match as (kind, start, end), with the part of it that is the secret."""
    found = []
    lower = text.lower()
    if any(name in lower for name in _BASE_NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                found.append((("assign", m.start(), m.end()), m.span(2)))
    if "AKIA" in text:
        found += [(("access", *m.span()), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(("hex", *m.span()), m.span()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """2 for a name that says secret, 1 for one that may, else 0. Names of public things score 0."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    joined = re.sub(r"[^a-z0-9]", "", parts)
    words = [w for w in re.split(r"[^a-z0-9]+", parts) if w]
    if not words or words[-1] in ("id", "name", "url", "file", "path", "type", "length", "size", "count", "public", "hint"):
        return 0.0
    if any(s in joined for s in STRONG):
        return 2.0
    return 1.0 if any(w in words for w in WEAK) or joined in WEAK else 0.0


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, entropy."""
    folded = value.lower()
    if len(value) < LEAST_LITERAL or folded in PLAIN or len(set(folded)) < 3 or " " in value.strip():
        return -10.0
    if value.startswith(("${", "<", "{{", "%(")) or folded.startswith(("http://", "https://", "./", "../")):
        return -10.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return 0.5 * (kinds - 1) + min(2.0, n / 12) + min(1.5, max(0.0, entropy - 2.0))


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, places of its literals, names it refers to) of every assignment, in order."""
    for head in _HEAD.finditer(text):
        name = head["name"] or head["flag"] or head["tag"]
        at, places, names = head.end(), [], []
        while term := _TERM.match(text, at):
            if term["quoted"] is not None:
                start, end = term.span("quoted")
                places.append((start, end))
                names += re.findall(r"\$\{([A-Za-z_][A-Za-z0-9_.-]*)\}", term["quoted"])
            elif term["braced"]:
                names.append(term["braced"])
            else:
                start, end = term.span("bare")
                bare = text[start:end].rstrip(".:!")
                if _NAME.fullmatch(bare):
                    names.append(bare)
                places.append((start, start + len(bare)))
            at = term.end()
            if not (more := _JOIN.match(text, at)):
                break
            at = more.end()
        if places or names:
            yield name, places, names


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that end up under a sensitive name, as spans of kind ``literal``."""
    # Names are judged without the marks inside them, so what a name may hold is sought in the text without those.
    joined = text.lower().replace("_", "").replace(".", "").replace("-", "").replace("$", "")
    if not any(part in joined for part in (*STRONG, *WEAK)):
        return []
    pairs = list(assignments(text))
    constants: dict[str, list[int]] = {}
    for k, (name, _, _) in enumerate(pairs):
        constants.setdefault(name.removeprefix("$"), []).append(k)
    weights = {name: name_score(name) for name in {name for name, _, _ in pairs}}
    best: dict[tuple[int, int], float] = {}
    reached, opened = set(), set()
    # From the heaviest names on, so that each assignment is walked once, with the best weight that reaches it.
    for weight in sorted({w for w in weights.values() if w}, reverse=True):
        waiting = [k for k, (name, _, _) in enumerate(pairs) if weights[name] == weight]
        while waiting:  # names may refer to each other in circles
            j = waiting.pop()
            if j in reached:
                continue
            reached.add(j)
            _, places, names = pairs[j]
            for place in places:
                best.setdefault(place, weight)
            for other in {n.removeprefix("$") for n in names} - opened:
                opened.add(other)
                waiting += constants.get(other, ())
    found = []
    for (start, end), weight in best.items():
        value = text[start:end]
        if value in constants:  # a reference, not a literal
            continue
        if weight + literal_score(value) >= threshold:
            found.append(("literal", start, end))
    return sorted(found, key=lambda s: s[1:])


def scan(text: str, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    """(base spans, all spans, places to hide), each in order of start, then kind.

    A literal inside a base span is not reported again.
    """
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = base_spans(text)
    spans = sorted((s for s, _ in base), key=order)
    starts, reach = [s[1] for s in spans], list(accumulate((s[2] for s in spans), max))
    inside = lambda s: (k := bisect_right(starts, s[1])) > 0 and reach[k - 1] >= s[2]
    more = [s for s in lexed_spans(text, threshold) if not inside(s)]
    hidden = sorted({place for _, place in base} | {(a, b) for _, a, b in more})
    return spans, sorted([*spans, *more], key=order), hidden


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, places: list[tuple[int, int]], mask: str) -> str:
    """The text with overlapping places hidden as one."""
    out, at = [], 0
    for start, end in places:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) of every row.

    Offsets count code points. Null and empty texts have no spans; repeated rows come out
    repeated; texts are scanned whole, one at a time.
    """

    def run(ids: list[int], bodies: list[str]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in _OUT.names}
        for doc_id, text in zip(ids, bodies, strict=True):
            base, spans, _ = scan(text, threshold)
            kinds = Counter(s[0] for s in spans)
            row = (doc_id, *(kinds[k] for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), kinds["literal"])
            for name, value in zip(_OUT.names, row, strict=True):
                out[name].append(value)
        return out

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return texts(docs).mapInArrow(over_slices(run, _OUT), ddl)


def hide_secrets(docs: DataFrame, mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """All documents, with the secrets in ``text`` masked and ``n_chars``, if there, made true again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, place = batch.column("text"), batch.schema.get_field_index("text")
            for a, b in slices(utf8(column)[1]):
                bodies = column.slice(a, b - a).to_pylist()
                clean = [t and redact(t, scan(t, threshold)[2], mask) for t in bodies]
                columns = batch.slice(a, b - a).columns
                columns[place] = pa.array(clean, column.type)
                if (at := batch.schema.get_field_index("n_chars")) >= 0:
                    kind = columns[at].type
                    counts = [n if t == c else len(c) for n, t, c in zip(columns[at].to_pylist(), bodies, clean, strict=True)]
                    columns[at] = pa.array(counts, kind)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_documents(spark, sf_dir))
