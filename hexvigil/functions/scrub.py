"""Scrubbing of personal and infrastructure details from text, in plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexvigil.functions.bind import once

# ---------------------------------------------------------------------------
# Patterns, replacement tokens and kept domains.
# ---------------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}"
URL = r"https?://[^\s<>\"]+"
TITLED_NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
INTERNAL_HOST = r"(?i)\b[a-zA-Z0-9][-a-zA-Z0-9]*\.(?:corp|internal|local|lan|intranet|private)\b"
API_KEY = (
    r"\b(?:sk_[a-zA-Z0-9_-]{20,}|pk_[a-zA-Z0-9_-]{20,}|ak_[a-zA-Z0-9_-]{20,}|AKIA[A-Z0-9]{16}"
    r"|xox[bpsa]-[a-zA-Z0-9-]+|ghp_[a-zA-Z0-9]{36}|glpat-[a-zA-Z0-9_-]{20,})\b"
)
AWS_ACCOUNT = r"\b\d{12}\b"
CERT_SERIAL = r"(?i)\b(?:serial[:\s]+)?[0-9A-Fa-f]{16,}\b"
DOMAIN = r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,}\b"

# Kept whatever the ending below; every other kept name ends in one of the safe endings.
SAFE_DOMAINS = ["orca.security"]
SAFE_TLDS = [".com", ".io", ".ai", ".co", ".org", ".gov", ".net"]

PII_STEPS = [(EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (URL, "[URL]"), (TITLED_NAME, "[NAME]")]
INFRA_STEPS = [
    (MAC, "[MAC_ADDR]"),
    (IPV4, "[IP_ADDR]"),
    (IPV6, "[IP_ADDR]"),
    (INTERNAL_HOST, "[INTERNAL_HOST]"),
    (API_KEY, "[API_KEY]"),
    (AWS_ACCOUNT, "[AWS_ACCOUNT]"),
    (CERT_SERIAL, "[CERT_SERIAL]"),
]
# Text that a match of the pattern must contain; a text without it is not searched.
NEEDED = {
    EMAIL: ["@"],
    URL: ["://"],
    TITLED_NAME: ["Mr", "Ms", "Dr", "Prof"],
    API_KEY: ["sk_", "pk_", "ak_", "AKIA", "xox", "ghp_", "glpat-"],
}
SCAN = {
    "email": EMAIL,
    "phone": PHONE,
    "url": URL,
    "titled_name": TITLED_NAME,
    "ipv4": IPV4,
    "ipv6": IPV6,
    "mac_address": MAC,
    "internal_host": INTERNAL_HOST,
    "api_key": API_KEY,
    "aws_account": AWS_ACCOUNT,
    "cert_serial": CERT_SERIAL,
}


def _may_match(text: Column, pattern: str) -> Column | None:
    out = None
    for part in NEEDED.get(pattern, []):
        hit = F.contains(text, F.lit(part))
        out = hit if out is None else out | hit
    return out


def _replace(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, token in steps:
        text = F.regexp_replace(text, pattern, token)
    return text


def scrub_pii(text: Column) -> Column:
    """E-mail, phone, URL, titled name, in this order."""
    return _replace(text, PII_STEPS)


def scrub_domains(text: Column) -> Column:
    """Every domain that is not kept becomes a token.

    Matches are judged from left to right, so the pieces between them are split off
    and zipped back with the judged matches.
    """
    safe_tlds = F.array(*[F.lit(t) for t in SAFE_TLDS])

    def judged(match: Column) -> Column:
        return once(
            F.lower(match),
            lambda low: F.when(
                low.isin(*SAFE_DOMAINS) | F.exists(safe_tlds, lambda t: F.endswith(low, t)), match
            ).otherwise("[DOMAIN]"),
        )

    def rebuilt(t: Column) -> Column:
        pieces = F.split(t, DOMAIN, -1)
        tokens = F.transform(F.regexp_extract_all(t, F.lit(DOMAIN), 0), judged)
        return F.array_join(
            F.zip_with(pieces, tokens, lambda piece, token: F.concat(piece, F.coalesce(token, F.lit("")))), ""
        )

    return once(text, rebuilt)


def scrub_infra(text: Column) -> Column:
    """Addresses, hosts, keys, accounts, serials, then domains."""
    return scrub_domains(_replace(text, INFRA_STEPS))


def scrub(text: Column) -> Column:
    return scrub_infra(scrub_pii(text))


# Words that no pattern can match any part of: letters, too few for a serial, between white space.  A run of them begins
# with a small letter, so that it can't be the name behind a title; titles and the word before a serial end it.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = (
    r"\s(?!serial\b)[{0}]{{1,15}}+[,;.!?]?+(?=\s)"
    r"(?:\s++(?!(?i:serial)\b|(?:Mrs?|Ms|Dr|Prof)\b)[A-Z{0}]{{1,15}}+[,;.!?]?+(?=\s))*+"
).format(_LETTERS)


def shortened(text: Column) -> Column:
    """The text with every run of plain words as one, for what only counts matches.

    It holds the matches of each pattern that the text holds, and scrubbed it holds those that the scrubbed text does: no
    match takes in a plain word or the white space beside it, and one such word keeps apart what the run did.
    """
    return F.regexp_replace(text, _PLAIN, " x")


def pattern_counts(text: Column) -> dict[str, Column]:
    """Matches of each pattern in a text."""
    clean = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        found = F.regexp_count(clean, F.lit(pattern))
        possible = _may_match(clean, pattern)
        return found if possible is None else F.when(possible, found).otherwise(0)

    return {name: count(pattern) for name, pattern in SCAN.items()}


def strip_html(html: Column) -> Column:
    """Tags to spaces, runs of white space to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def unescape_html(text: Column) -> Column:
    """The named and numeric entities of ordinary prose; the ampersand last."""
    for entity, char in [
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&#x27;", "'"),
        ("&apos;", "'"),
        ("&#x2F;", "/"),
        ("&nbsp;", " "),
        ("&amp;", "&"),
    ]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
