"""Question text to numbers and dates, as column expressions.

A question is read only when it is unambiguous; everything else stays null,
because a false relation is worse than a missing one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: phrases, patterns and scales that decide the results -------
UNICODE_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
UNIT = (
    r"\s*(?:%|°?[FC]\b|bps\b|bp\b|basis\s*points?|percent|thousand\b|million\b"
    r"|billion\b|trillion\b|bn\b|[KMB]\b)?"
)
# (phrase, direction, inclusive, needs the resolution criteria)
LEADING = [
    (r"at\s+least", "gt", True, False),
    (r"greater\s+than\s+or\s+equal\s+to", "gt", True, False),
    (r"no\s+less\s+than", "gt", True, False),
    (r"more\s+than", "gt", False, False),
    (r"greater\s+than", "gt", False, False),
    (r"above", "gt", False, False),
    (r"over", "gt", False, False),
    (r"exceeds?", "gt", False, False),
    (r"≥|>=", "gt", True, False),
    (r">", "gt", False, False),
    (r"reach(?:es|ed)?(?:\s+to)?", "gt", True, True),
    (r"hits?", "gt", True, True),
    (r"surpass(?:es|ed)?", "gt", False, False),
    (r"cross(?:es|ed)?", "gt", False, False),
    (r"climbs?\s+to", "gt", True, False),
    (r"rises?\s+to", "gt", True, False),
    (r"tops", "gt", False, False),
    (r"dips?\s+to", "lt", True, False),
    (r"falls?\s+to", "lt", True, False),
    (r"drops?\s+to", "lt", True, False),
    (r"declines?\s+to", "lt", True, False),
    (r"sinks?\s+to", "lt", True, False),
    (r"at\s+most", "lt", True, False),
    (r"no\s+more\s+than", "lt", True, False),
    (r"less\s+than\s+or\s+equal\s+to", "lt", True, False),
    (r"less\s+than", "lt", False, False),
    (r"fewer\s+than", "lt", False, False),
    (r"below", "lt", False, False),
    (r"under", "lt", False, False),
    (r"≤|<=", "lt", True, False),
    (r"<", "lt", False, False),
]
TRAILING = [
    (r"or\s+(?:higher|above|more|greater|better)", "gt"),
    (r"or\s+(?:lower|below|less|fewer|worse)", "lt"),
]
BAND_WORDS = r"(?i)\bbetween\b[^?]*\band\b"
BAND_DASH = r"\d\s*(?:–|—|-|\bto\b)\s*\$?\d"
RESIDUAL = r"(?i)\$\s*\d|\d\s*\+|\d\s*%|\d\s*(?:bps|basis\s*points?)\b"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE_CLAUSE = (
    r"(?i)\b(?:on|by|before|after|during|in|at)\s+(?:the\s+)?"
    rf"(?:{MONTH}|\d{{4}}|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?)[^?]*\??\s*$"
)
BELOW_CRITERIA = r"\b(?:equal to or below|at or below|or below the listed|less than or equal to)\b"
ABOVE_CRITERIA = (
    r"\b(?:equal to or above|at or above|or above the listed|greater than or equal to"
    r"|or higher than the listed)\b"
)
DEADLINE_WORD = r"(?i)\b(?:by|before|prior\s+to|no\s+later\s+than)\b"
DEADLINE_CLAUSE = (
    r"(?i)\s*(?:by|before|prior\s+to|no\s+later\s+than)\s+(?:the\s+end\s+of\s+)?"
    rf"({MONTH}\s*\d{{0,2}}(?:st|nd|rd|th)?(?:,?\s*\d{{4}})?"
    r"|\d{1,2}/\d{1,2}(?:/\d{2,4})?|(?:Q[1-4]\s*)?\d{4})\s*\??\s*$"
)
INSTANT = rf"(?i)\b(?:on|at)\s+(?:the\s+)?(?:{MONTH}|\d{{1,2}}/\d{{1,2}})"
BAND = r"^(.*?)between\s+\$?([\d,.]+)\s*([KkMmBb]?)\s+and\s+\$?([\d,.]+)\s*([KkMmBb]?)(.*)$"
SUBJECT_TAIL = r"(?i)\s+(?:be|is|are|was|were|reach|hit|close|closes|at|of|by|to)$"
EDGE_PUNCTUATION = r"[\s,;:–—-]+$"
CONTRACTIONS = [
    (r"(?i)\bwon't\b", "will not"),
    (r"(?i)\bdoesn't\b", "does not"),
    (r"(?i)\bdon't\b", "do not"),
    (r"(?i)\bisn't\b", "is not"),
    (r"(?i)\baren't\b", "are not"),
    (r"(?i)\bwont\b", "will not"),
]
NEGATIONS = [
    (r"\bwill\s+not\b", "will"),
    (r"\bdoes\s+not\b", "does"),
    (r"\bdo\s+not\b", "do"),
    (r"\bis\s+not\b", "is"),
    (r"\bare\s+not\b", "are"),
    (r"\bnot\b", ""),
    (r"\bnever\b", ""),
]
CATEGORIES = [
    (
        "sports",
        r"(?i)\b(nba|nfl|mlb|nhl|ncaa|epl|uefa|fifa|ufc|atp|wta|f1|formula 1|premier league"
        r"|la liga|serie a|bundesliga|super bowl|world cup|stanley cup|world series|moneyline"
        r"|spread|vs\.?|game|match|tournament|playoff|championship|soccer|football|basketball"
        r"|baseball|hockey|tennis|golf|boxing|cricket)\b",
    ),
    (
        "crypto",
        r"(?i)\b(bitcoin|btc|ethereum|eth|solana|sol|xrp|ripple|dogecoin|doge|cardano|crypto"
        r"|altcoin|stablecoin|defi|nft|binance|coinbase|satoshi|halving|memecoin)\b",
    ),
    (
        "economics",
        r"(?i)\b(fed|fomc|federal reserve|powell|interest rate|rate cut|rate hike|inflation|cpi"
        r"|pce|gdp|unemployment|jobs report|payroll|recession|treasury|yield|ecb|boe|boj|tariff"
        r"|debt ceiling|s&p|nasdaq|dow)\b",
    ),
    (
        "politics",
        r"(?i)\b(election|president|presidential|senate|senator|congress|house|parliament"
        r"|prime minister|chancellor|governor|mayor|nominee|nomination|primary|caucus|ballot"
        r"|impeach|cabinet|secretary of|supreme court|referendum|coalition|party leader"
        r"|approval rating|resign|ceasefire|sanction|nato|un security)\b",
    ),
]
# ------------------------------------------------------------------------------


def _settled(value: Column) -> Column:
    """The value as a generated column: one row in, one row out.

    Filters on a projected column are rewritten into the expressions behind it, and a
    long chain of text steps would be copied into every filter. They stop here.
    """
    return F.explode(F.array(value))


def tidy(text: Column) -> Column:
    """Straight quotes, single spaces, no outer spaces."""
    out = F.regexp_replace(text, "[‘’]", "'")
    out = F.regexp_replace(out, "[“”]", '"')
    return F.trim(F.regexp_replace(out, UNICODE_SPACE, " "))


def collapse_spaces(text: Column) -> Column:
    """The text an embedding model is given."""
    return F.trim(F.regexp_replace(text, UNICODE_SPACE, " "))


def _scaled(digits: Column, dollar: Column, suffix: Column) -> Column:
    """Number literal and its unit markers to struct(value, unit)."""
    tail = F.lower(F.trim(suffix))
    size = F.regexp_replace(digits, ",", "").try_cast("double")
    word = (
        F.when(tail.rlike(r"^thousand\b"), 1e3)
        .when(tail.rlike(r"^million\b"), 1e6)
        .when(tail.rlike(r"^billion\b"), 1e9)
        .when(tail.rlike(r"^trillion\b"), 1e12)
        .when(tail.rlike(r"^bn\b"), 1e9)
    )
    initial = F.substring(tail, 1, 1)
    letter = F.when(initial == "k", 1e3).when(initial == "m", 1e6).when(initial == "b", 1e9)
    letter = F.coalesce(letter, F.lit(1.0))
    bps = tail.rlike(r"^(?:bps|bp\b|basis\s*points?)")
    percent = tail.startswith("%") | tail.startswith("percent")
    degrees = tail.rlike(r"^°?[fc]\b")
    factor = (
        F.when(bps | percent | degrees, 1.0)
        .when(word.isNotNull(), word)
        .when(dollar | tail.rlike(r"^[kmb]\b"), letter)
        .otherwise(1.0)
    )
    unit = (
        F.when(bps, "bps")
        .when(percent, "percent")
        .when(degrees, "temperature")
        .when(dollar, "usd")
        .otherwise("count")
    )
    return F.struct((size * factor).alias("value"), unit.alias("unit"))


def direction_from_criteria(description: Column) -> Column:
    """'lt' or 'gt' where the criteria name exactly one side, else null."""
    text = F.lower(description)
    below, above = text.rlike(BELOW_CRITERIA), text.rlike(ABOVE_CRITERIA)
    return F.when(below & ~above, "lt").when(above & ~below, "gt")


def _names(phrase: str) -> str:
    """SQL test whether ``__low`` holds the letters that each alternative of a phrase begins with.

    A plain search is far cheaper than a pattern, and few questions hold more than one or two.
    """
    heads = []
    for alternative in [phrase] if "(" in phrase else phrase.split("|"):
        head, after = re.match(r"([^\\(?*+\[|]+)(.?)", alternative).groups()
        heads.append(head[:-1] if after in ("?", "*") and after else head)
    return "(" + " or ".join(f"contains(__low, '{h}')" for h in heads) + ")"


def parse_thresholds(df: DataFrame, question: str = "question", description: str | None = "description") -> DataFrame:
    """Add ``parse``: struct(subject, direction, inclusive, threshold, unit, date_text) or null.

    Each comparator phrase contributes at most its first match; a question whose
    matches disagree on direction, value or unit is refused, as are numeric bands
    and subjects that still hold a threshold.
    """
    phrases = "|".join(p for p, *_ in LEADING)
    tails = "|".join(p for p, _ in TRAILING)
    # Most questions name no number next to a comparator: test once before the full search.
    hint = rf"(?i)(?:{phrases})\s*\$?\s*\d|\d.*(?:{tails})|\d\s*\+"

    text = F.col("__text")
    found = [(_names(p), rf"(?i)(?:{p})\s*(\$)?\s*({NUMBER})({UNIT})", d, inc, amb) for p, d, inc, amb in LEADING]
    found += [(_names(p), rf"(?i)(\$)?\s*({NUMBER})({UNIT})\s*(?:{p})", d, True, False) for p, d in TRAILING]
    found.append(("contains(__low, '+')", rf"(?i)(\$)?\s*({NUMBER})\s*\+({UNIT})", "gt", True, False))
    slots = F.expr("array(" + ", ".join(
        f"named_struct('m', if({named}, regexp_extract(__text, r'{pattern}', 0), ''), 'direction', '{d}', "
        f"'inclusive', {inc}, 'ambiguous', {amb}, 'slot', {i})"
        for i, (named, pattern, d, inc, amb) in enumerate(found)
    ) + ")")
    number = rf"(?i)(\$)?\s*({NUMBER})\s*\+?({UNIT})"

    def measured(x: Column) -> Column:
        scaled = _scaled(
            F.regexp_extract(x["m"], number, 2),
            F.regexp_extract(x["m"], number, 1) == "$",
            F.regexp_extract(x["m"], number, 3),
        )
        return F.struct(
            F.call_function("instr", text, x["m"]).alias("start"),
            x["slot"].alias("slot"),
            F.length(x["m"]).alias("width"),
            x["direction"].alias("direction"),
            x["inclusive"].alias("inclusive"),
            x["ambiguous"].alias("ambiguous"),
            scaled.alias("number"),
        )

    keep = df.columns
    out = df.withColumn("__text", tidy(F.col(question))).withColumn("__low", F.lower("__text"))
    readable = (
        (text != "") & ~text.rlike(BAND_WORDS) & ~text.rlike(BAND_DASH) & text.rlike(hint)
    )
    out = out.withColumn("__hits", F.when(readable, F.filter(slots, lambda x: x["m"] != "")))
    out = out.withColumn("__hits", F.transform("__hits", measured))
    out = out.withColumn("__hits", F.filter("__hits", lambda x: x["number"]["value"].isNotNull()))
    agreeing = F.size(
        F.array_distinct(F.transform("__hits", lambda x: F.struct(x["direction"], x["number"])))
    )
    out = out.withColumn("__c", F.when(agreeing == 1, F.array_min("__hits")))
    criteria = (
        direction_from_criteria(F.col(description)) if description else F.lit(None).cast("string")
    )
    out = out.withColumn(
        "__dir", F.when(F.col("__c.ambiguous"), criteria).otherwise(F.col("__c.direction"))
    )
    start, width = F.col("__c.start"), F.col("__c.width")
    rest = F.concat(F.substring(text, F.lit(1), start - 1), F.lit(" "), F.substring(text, start + width, F.length(text)))
    out = out.withColumn("__rest", F.when(F.col("__dir").isNotNull(), rest))
    out = out.withColumn("__date", F.regexp_extract("__rest", DATE_CLAUSE, 0))
    head = F.substring(F.col("__rest"), F.lit(1), F.length("__rest") - F.length("__date"))
    subject = F.regexp_replace(tidy(head), EDGE_PUNCTUATION, "")
    subject = F.regexp_replace(subject, SUBJECT_TAIL, "")
    subject = F.regexp_replace(subject, EDGE_PUNCTUATION, "")
    subject = F.lower(F.trim(F.regexp_replace(subject, r"^\W+", "")))
    out = out.withColumn("__subject", subject)
    date_text = F.lower(F.regexp_replace(tidy(F.col("__date")), r"[?\s]+$", ""))
    parse = F.struct(
        F.col("__subject").alias("subject"),
        F.col("__dir").alias("direction"),
        F.col("__c.inclusive").alias("inclusive"),
        F.col("__c.number.value").alias("threshold"),
        F.col("__c.number.unit").alias("unit"),
        F.when(F.col("__date") != "", date_text).alias("date_text"),
    )
    ok = F.col("__subject").isNotNull() & ~F.col("__subject").rlike(RESIDUAL)
    return out.select(*keep, _settled(F.when(ok, parse)).alias("parse"))


def parse_deadlines(df: DataFrame, question: str = "question") -> DataFrame:
    """Add ``deadline``: struct(subject, deadline_text), or null when it is not a deadline."""
    keep = df.columns
    out = df.withColumn("__text", tidy(F.col(question)))
    clause = F.regexp_extract("__text", DEADLINE_CLAUSE, 0)
    out = out.withColumn(
        "__clause", F.when(F.col("__text").rlike(DEADLINE_WORD), clause).otherwise("")
    )
    head = F.substring(F.col("__text"), F.lit(1), F.length("__text") - F.length("__clause"))
    subject = F.lower(F.regexp_replace(tidy(head), EDGE_PUNCTUATION, ""))
    out = out.withColumn("__subject", F.when(F.col("__clause") != "", subject))
    when_text = F.lower(tidy(F.regexp_extract("__text", DEADLINE_CLAUSE, 1)))
    ok = (F.col("__subject") != "") & ~F.col("__subject").rlike(INSTANT)
    parse = F.struct(F.col("__subject").alias("subject"), when_text.alias("deadline_text"))
    return out.select(*keep, _settled(F.when(ok, parse)).alias("deadline"))


def parse_bands(df: DataFrame, question: str = "question") -> DataFrame:
    """Add ``band``: struct(prefix, suffix, low, high), or null."""

    def bound(digits: int, suffix: int) -> Column:
        text = F.regexp_replace(F.regexp_extract(question, BAND, digits), ",", "")
        # `1.2.3` or a bare dot is no number; Spark's cast would also take `1d` but the pattern cannot.
        letter = F.lower(F.regexp_extract(question, BAND, suffix))
        scale = F.when(letter == "k", 1e3).when(letter == "m", 1e6).when(letter == "b", 1e9).otherwise(1.0)
        return text.try_cast("double") * scale

    keep = df.columns
    out = df.withColumn("__low", bound(2, 3)).withColumn("__high", bound(4, 5))
    band = F.struct(
        F.trim(F.regexp_extract(question, BAND, 1)).alias("prefix"),
        F.trim(F.regexp_extract(question, BAND, 6)).alias("suffix"),
        F.col("__low").alias("low"),
        F.col("__high").alias("high"),
    )
    return out.select(*keep, _settled(F.when(F.col("__low") < F.col("__high"), band)).alias("band"))


def bands_disjoint(a: Column, b: Column) -> Column:
    """Same subject and date, and half-open intervals that cannot both hold."""
    same = (a["prefix"] == b["prefix"]) & (a["suffix"] == b["suffix"])
    return same & ((a["high"] <= b["low"]) | (b["high"] <= a["low"]))


def normalise_question(question: Column) -> Column:
    """Comparison key: case, contractions, quotes, end punctuation and spacing removed."""
    out = F.regexp_replace(question, "[‘’]", "'")
    for pattern, expanded in CONTRACTIONS:
        out = F.regexp_replace(out, pattern, expanded)
    out = F.lower(F.regexp_replace(out, "[“”]", '"'))
    out = F.regexp_replace(out, r"[?!.]+\s*$", "")
    return F.trim(F.regexp_replace(out, UNICODE_SPACE, " "))


def positive_forms(normalised: Column) -> Column:
    """Distinct texts left after deleting one kind of negation."""
    forms = []
    for pattern, kept in NEGATIONS:
        form = F.regexp_replace(normalised, pattern, kept)
        forms.append(F.trim(F.regexp_replace(form, UNICODE_SPACE, " ")))
    return F.array_distinct(F.filter(F.array(*forms), lambda f: (f != "") & (f != normalised)))


def category(question: Column, slug: Column) -> Column:
    """First keyword family that matches slug and question, else 'other'."""
    text = F.concat(F.coalesce(slug, F.lit("")), F.lit(" "), F.coalesce(question, F.lit("")))
    out = None
    for name, pattern in CATEGORIES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("other")
