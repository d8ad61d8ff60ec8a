"""Secret scans: fixed patterns, and values in a credential's place that are hard to guess.

The cost of guessing a value is the cheapest way to write it as words, dates, repeated characters, keyboard walks and
plain characters, found by dynamic programming over its positions, in bits.  Random tokens stay expensive whatever
their form; ``changeme``, ``qwerty123`` or a date come out cheap.  Words are those that guessing starts with, then the
commonest of the documents themselves, whatever their languages, ranked by how many documents hold them.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import with_fields
from hexvigil.session import cut_lineage

#: Values in a credential's place from this cost on are secrets.
BITS = 36.0

#: Words that are learned from the documents at most, and how many documents hold one at least.
LEARNED, LEAST = 50_000, 3

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Other places where a credential stands: further names, the password of an address, an authorisation header.  A name
#: may be part of a longer one (DB_PASSWORD_2, redisPassword, dbpass), but not of an English word; "is" follows whole words.
_NAMED = re.compile(
    r"""((?<![A-Za-z]))?(?:(?<!com)(?<!by)(?<!tres)(?<!sur)pass|pass(?:word|wd|phrase|code)|pwd|secret(?:key)?|token"""
    r"""|(?:api|access|private|client|auth)[_.-]?(?:key|token|secret))s?"""
    r"""(?:[_.-]{0,4}[0-9]{1,64}+|[_.-]{1,4}[A-Za-z0-9]{1,64}+|(?-i:(?<=[a-z0-9])[A-Z]{1,64}[a-z0-9]{0,64}+)){0,32}+"""
    r"""["']?[\x20\t]*(?:[:=]|=>|(?(1)\bis))[\x20\t]*["'`]?([!#-&(-_a-~]{6,})""",
    re.A | re.I,
)
_ADDRESS = re.compile(r"://[^\s:/@]+:([^\s@/]{6,})@")
_HEADER = re.compile(r"\b(?:bearer|basic)[\x20\t]+([A-Za-z0-9+/_.=-]{6,})", re.A | re.I)
_HINTS = ("pass", "pwd", "secret", "token", "key", "://", "bearer", "basic")

# Words that guessing starts with, commonest first, and rows of a keyboard.
WORDS = (
    "password", "the", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "hello", "love", "secret",
    "changeme", "change", "default", "example", "test", "user", "guest", "root", "pass", "token", "key", "none", "null",
    "true", "false", "value", "string", "your", "here", "insert", "placeholder", "sample", "dummy", "demo", "foo", "bar",
    "public", "private", "access", "api", "auth", "bearer", "basic", "config", "setting", "name", "data", "server",
    "summer", "winter", "spring", "autumn", "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december", "monday", "friday", "sunday", "shadow", "football", "baseball",
    "princess", "sunshine", "flower", "freedom", "whatever", "trust", "iloveyou", "ninja", "hunter", "batman", "superman",
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")

#: A word of the documents: letters between anything that is neither letter nor digit, as a value would hold it.
_WORD = r"(?<![\p{L}\p{N}])\p{L}{3,24}(?![\p{L}\p{N}])"
_IS = re.compile(r"\bis[\x20\t]*$", re.I)
_DATE = re.compile(r"(?:19|20)\d\d([-./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-./]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x[:-1], x[1:], strict=True)}
#: Beginnings of a piece of a long repeat or walk that are tried, besides its own.
NEAR = 32
_PLAIN = str.maketrans("@4310!$57", "aaeioisst")


def _alphabet(c: str) -> float:
    return log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


class Ranks(dict):
    """Rank of each word, from 1: the fixed ones, then others in their order."""

    def __init__(self, words=()):
        super().__init__()
        for word in (*WORDS, *words):
            self.setdefault(word, len(self) + 1)
        self.longest = max(map(len, self))


_RANK = Ranks()


def common_words(docs: DataFrame, most: int = LEARNED, least: int = LEAST) -> list[str]:
    """At most ``most`` words of ``docs`` (text), lower-cased, those that most documents hold, at least ``least``.

    Each document counts a word once; the commonest come first, equal ones by name.  Counts are taken by steps of a 64th
    of an octave, as far as all words of a step fit, so the driver gets the sizes of some thousand steps and ``most`` words.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counted = cut_lineage(counted.withColumn("step", F.floor(F.log2("n") * 64)))
    total, lowest = 0, None
    for step, n in sorted(((r["step"], r["count"]) for r in counted.groupBy("step").count().collect()), reverse=True):
        if total + n > most:
            break
        total, lowest = total + n, step
    if lowest is None:
        return []
    found = counted.filter(F.col("step") >= lowest).select("n", "word").collect()
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def guess_bits(value: str, rank: Ranks = _RANK) -> float:
    """Bits of the cheapest segmentation of ``value``; 0 for an empty one.  Linear in its length."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(_PLAIN)
    best = [0.0] + [float("inf")] * n
    run = walk = 0  # lengths of the repeat and the keyboard walk that end here
    dates: dict[int, list[tuple[int, float]]] = {}
    if any(c.isdigit() for c in value):
        for i in range(n):
            if low[i].isdigit() and (m := _DATE.match(low, i)):
                dates.setdefault(m.end(), []).append((i, log2(365 * 120) if m.end() - i > 4 else log2(120)))
                if m.end() - i > 4 and low[i : i + 2] in ("19", "20"):
                    dates.setdefault(i + 4, []).append((i, log2(120)))
    run_from = walk_from = 0.0
    for j in range(1, n + 1):
        c = low[j - 1]
        # Repeats and walks grow by one character.  A piece of one begins at its first character or among the last ones.
        if j > 1 and c == low[j - 2]:
            run += 1
        else:
            run, run_from = 1, best[j - 1]
        if j > 1 and (low[j - 2], c) in _NEXT:
            walk += 1
        else:
            walk, walk_from = 1, best[j - 1]
        cost = best[j - 1] + _alphabet(value[j - 1])
        if run >= 3:
            near = min(best[j - k] + log2(k) for k in range(3, min(run, NEAR) + 1))
            cost = min(cost, 1 + _alphabet(c) + min(near, run_from + log2(run)))
        if walk >= 3:
            near = min(best[j - k] + log2(k) for k in range(3, min(walk, NEAR) + 1))
            cost = min(cost, 1 + log2(len(ROWS) * 10) + min(near, walk_from + log2(walk)))
        for i, bits in dates.get(j, ()):
            cost = min(cost, best[i] + 1 + bits)
        for i in range(max(0, j - rank.longest), j - 2):
            if place := rank.get(low[i:j]) or rank.get(plain[i:j]):
                more = (value[i:j] != low[i:j]) + 2 * (low[i:j] != plain[i:j])
                cost = min(cost, best[i] + 1 + log2(place + 1) + more)
        best[j] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def guessed_spans(text: str, taken: list[tuple[int, str, int]], bits: float, rank: Ranks = _RANK) -> list[tuple[int, str, int]]:
    """Values in a credential's place that no span of ``taken`` touches and that cost at least ``bits``.

    After a mere "is" a value of letters alone goes on with the sentence, so it is none.
    """
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    out = set()
    for pattern in (_NAMED, _ADDRESS, _HEADER):
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex)
            prose = pattern is _NAMED and text[a:b].strip(".,;!?)").isalpha() and _IS.search(text, max(0, a - 8), a)
            if not prose and all(b <= x or a >= y for x, _, y in taken) and guess_bits(text[a:b], rank) >= bits:
                out.add((a, "guess", b))
    kept: list[tuple[int, str, int]] = []
    for span in sorted(out):
        if not kept or span[0] >= kept[-1][2]:
            kept.append(span)
    return kept


def joined(spans: list[tuple[int, str, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], kinds.index(s[1]), s[2])))


def _sent(docs: DataFrame, words: list[str] | None):
    return docs.sparkSession.sparkContext.broadcast(list(words or ()))


def _scanner(bits: float, words):
    def run(batches):
        rank = Ranks(words.value)
        for batch in batches:
            out = []
            for text in batch["text"].fillna("").tolist():
                base = base_spans(text)
                spans = base + guessed_spans(text, base, bits, rank)
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS[:3]]
                places = [{"kind": k, "start": a, "end": b} for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))]
                out.append((*counts, hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(spans, KINDS), places))
            found = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"])
            yield found.assign(**{c: batch[c].array for c in batch.columns if c not in found})

    return run


def scan_secrets(docs: DataFrame, bits: float = BITS, words: list[str] | None = None) -> DataFrame:
    """``docs`` (text and any others) with n_assign, n_access, n_hex, base_sha256, spans and secrets.

    ``secrets`` lists (kind, start, end) in code points, end exclusive, by start; ``spans`` is the same as text, and
    the counts and the digest cover the fixed patterns only.  Kind ``guess`` marks values that the patterns miss.
    ``words``, commonest first, are cheap to guess (``common_words``).  Null and empty texts have no span.  Columns of
    ``docs`` with a result's name are replaced.
    """
    docs = docs.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets")
    found = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    schema = with_fields(docs.schema, found + ", secrets array<struct<kind:string,start:long,end:long>>")
    return docs.mapInPandas(_scanner(bits, _sent(docs, words)), schema)


def _redactor(bits: float, mark: str, words):
    def clean(text: str | None, rank: Ranks) -> str | None:
        if text is None:
            return None
        base, out, at = base_spans(text), [], 0
        for a, _, b in sorted(base + guessed_spans(text, base, bits, rank)):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        rank = Ranks(words.value)
        for batch in batches:
            texts = [clean(t, rank) for t in batch["text"]]
            if "n_chars" in batch:
                changed = [t is not None and t != was for t, was in zip(texts, batch["text"], strict=True)]
                batch["n_chars"] = [len(t) if c else n for t, c, n in zip(texts, changed, batch["n_chars"], strict=True)]
                batch["n_chars"] = batch["n_chars"].astype("Int64")
            yield batch.assign(text=texts)

    return run


def redact(docs: DataFrame, bits: float = BITS, mark: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """``docs`` (text, n_chars and any others) with every secret of the text replaced by ``mark``; null texts stay null.

    Spans that overlap are replaced together.  ``n_chars``, if there, follows where a text changes.
    """
    return docs.mapInPandas(_redactor(bits, mark, _sent(docs, words)), docs.schema)
