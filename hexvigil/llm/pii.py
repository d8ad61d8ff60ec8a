"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens with the begin and inside of each kind from features of their shape and their neighbours'.  It
is trained here from a small labelled table of sentences.  Its lattice admits personal data only within a few tokens
of a digit, an ``@`` or a spelled one; everything else is outside by definition, so only the stretches around such
tokens are decoded, by Viterbi over all stretches of a batch at once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hexvigil.llm.common import with_fields

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
DIMENSIONS = 1 << 13
#: Tokens on either side of an anchor that may belong to the same span, and characters that hold them.
REACH, ROOM = 6, 60
EPOCHS, RATE, DECAY = 60, 0.1, 1e-4

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_ANCHOR = re.compile(r"[0-9@]+|(?i:\b(?:at|dot)\b)")
_SPACE = re.compile(r"\s")

# The labelled table: [kind text] marks a span, all else is outside.
TABLE = """
write to [email anna . smith @ example . org] for the files
my address is [email j.doe at example dot com] if you need it
contact [email bob (at) mail (dot) example (dot) net] about the offer
reach me under [email maria_lopez at uni dot edu] or in person
mail: [email info [at] shop [dot] example [dot] org] please
send it to [email sales AT firm DOT co DOT uk] today
write to [email joe at corp dot com] or call us
or write to [email h . lane at press dot info]
at home they look at the dot on the map
we met at noon and left at 5 pm
look at example 3 and at table 4
they arrived at 10 . the rest came at 12
the server [ip 10 . 0 . 0 . 12] did not answer
host [ip 192[.]168[.]1[.]20] was blocked
traffic from [ip 172 . 16 . 254 . 1] rose sharply
block [ip 203[.]0[.]113[.]9] at the gate
version 2 . 4 . 1 was released on 3 . 5 . 2021
chapter 1 . 2 . 3 has 4 figures
his card [card 4111 - 1111 - 1111 - 1111] was declined
pay with [card 5500.0000.0000.0004] before friday
visa [card 4012 8888  8888 1881] expires 12 / 27
amex number [card 3782 822463 10005] was stored
order 4412 8871 shipped with 3 items
invoice 20210045 totals 1 250 . 00 euro
call [phone ( 555 ) 123 - 4567] after six
phone : [phone 030 - 1234567] in berlin
tel . [phone 0171 / 555 12 34] works best
telefon [phone 089 12345678] ist besetzt
ring [phone 555 - 867 - 5309] and ask for her
mobile [phone 07700 900 123] is off
fax [phone ( 030 ) 555 - 0199] or post
teléfono [phone 91 555 12 34] por la tarde
appelez le [phone 01 23 45 67 89] avant midi
dial [phone 1 - 800 - 555 - 0199] for help
the number is [phone 555 0142 99] now
call me at [phone 212 555 0187] or at work
his cell [phone ( 415 ) 555 - 2671] rang twice
in 1998 there were 12 000 people here
between 1914 and 1918 the town grew by 300
page 12 of 345 shows 7 lines
the sum of 100 200 and 300 is 600
room 101 opens at 8 : 30 on 12 / 05 / 2020
2021 - 03 - 14 12 : 45 : 01 error 503
item 55 costs 12 . 99 and item 56 costs 9 . 50
from 10 to 20 percent of 5000 users left
article 12 ( 3 ) of the act of 2004
population 1 234 567 in the census of 2011
the score was 3 - 2 after 90 minutes
build 1048 passed 998 of 1000 tests
isbn 978 - 3 - 16 - 148410 - 0 is out of print
weighs 75 kg and is 180 cm tall
hash 9 f 86 d 081 8 was logged
route 66 runs 3 940 km
see section 4 . 2 or mail the team at once
write to [email john (dot) smith (at) corp (dot) com] soon
[email mary ( dot ) poe ( at ) mail ( dot ) org] knows more
[email tim dot berg at post dot site dot net] is best
[email kim_2 at box dot org] reads it
[email dora at verlag dot de] hilft weiter
[email ana @ casa . es] contesta
[email lee - ray @ web . de] bitte
[email a.b ( at ) c . net] is fine
ask [email zoe [dot] hart [at] lab [dot] io] first
the host [ip 10 (dot) 1 (dot) 2 (dot) 3] is down
scan [ip 172 . 20 . 0 . 254] again
card [card 5555 . 5555 . 5555 . 4444] please
card [card 6011 / 0009 / 9013 / 9424] is lost
card [card 3530_1113_3330_0000] works
llama al [phone 91 423 55 66] mañana
handy [phone 0151 / 234 56 78] abends
fax [phone 555 . 200 . 1234] is broken
appelle au [phone 05 61 22 33 44] ce soir
order number 212 444 9081 shipped on monday
ticket 8831 442 917 was closed
serial 4419 2201 7781 is worn
parcel 0049 1177 3321 left
account 77 812 345 was checked
reference 040 7654321 was stored
the dot at the end is red
a talk at dot com days 2001
item number 300 412 7765 is sold
our id 0171 2345 is new
"""

#: Words near a span that tell its kind.
CUES = {
    "phone": "call phone tel telefon teléfono téléphone appelez dial mobile cell fax ring number handy móvil",
    "email": "mail email e contact write send address reach correo",
    "card": "card visa amex mastercard credit karte carte tarjeta",
    "ip": "ip host server gate traffic block address",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` so that long runs without one take linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _EMAIL_TAIL.match(text, at)):
            end = last = m.end()
            out.append((start, end))
        at = text.find("@", end)
    return out


def _address(digits: list[str]) -> bool:
    return len(digits) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in digits)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind; failing ones are dropped."""
    out = [(a, "email", b) for a, b in _emails(text)]
    if not _ANCHOR.search(text):
        return out
    for m in _IP.finditer(text):
        if _address(m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


# Tokens and features -------------------------------------------------------------------------------------------------


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 9)}"
    if token[0].isalpha():
        return ("X" if token[0].isupper() else "x") + ("x" if len(token) > 1 else "") + ("X" if token.isupper() and len(token) > 1 else "")
    return token


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "replace"), digest_size=4).digest(), "little") % DIMENSIONS


def _features(tokens: list[str], gaps: list[int]) -> list[list[int]]:
    """Feature slots of each token: shapes around it, whether it touches its neighbours, and cue words before it."""
    shapes = ["<", "<", *map(_shape, tokens), ">", ">"]
    low = [t.lower() for t in tokens]
    cue, out = "", []
    seen = -9
    for i, token in enumerate(low):
        near = "0" if not gaps[i] else "1"
        after = "0" if i + 1 < len(gaps) and not gaps[i + 1] else "1"
        s = shapes[i : i + 5]
        word = token if token in ("at", "dot", "@", ".", "-", "(", ")", "[", "]", "/", "_") else "*"
        known = cue if i - seen <= 8 else ""
        names = (
            f"0{s[2]}", f"1{s[1]}{s[2]}", f"2{s[2]}{s[3]}", f"3{s[1]}{s[2]}{s[3]}", f"4{s[0]}{s[1]}{s[2]}", f"5{s[2]}{s[3]}{s[4]}",
            f"6{word}{near}{after}", f"7{s[2]}{known}", f"8{known}{s[1]}", f"9{word}{low[i - 1] if i and low[i - 1] in ('at', 'dot') else ''}",
        )
        out.append([_slot(n) for n in names])
        if token in _CUE:
            cue, seen = _CUE[token], i
    return out


def _split(text: str, start: int = 0, end: int | None = None):
    found = list(_TOKEN.finditer(text, start, len(text) if end is None else end))
    places = [m.span() for m in found]
    gaps = [1] + [int(b[0] > a[1]) for a, b in zip(places[:-1], places[1:], strict=True)]
    return [m[0] for m in found], places, gaps


def parse_table(table: str = TABLE):
    """(features, labels) of each line of a labelled table."""
    out = []
    mark = re.compile(rf"\[({'|'.join(KINDS)}) ((?:[^\[\]]|\[(?:at|dot|\.)\])*)\]")
    for line in filter(None, table.split("\n")):
        plain, spans, last = "", [], 0
        for m in mark.finditer(line):
            plain += line[last : m.start()]
            spans.append((len(plain), len(plain) + len(m[2]), m[1]))
            plain += m[2]
            last = m.end()
        plain += line[last:]
        tokens, places, gaps = _split(plain)
        labels = [0] * len(tokens)
        for a, b, kind in spans:
            inside = [i for i, (x, y) in enumerate(places) if x >= a and y <= b]
            for n, i in enumerate(inside):
                labels[i] = LABELS.index(("I-" if n else "B-") + kind)
        out.append((np.array(_features(tokens, gaps)), np.array(labels)))
    return out


# The field -----------------------------------------------------------------------------------------------------------


def _allowed() -> np.ndarray:
    """Which label may follow which: an inside only its own kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            ok[:, j] = [x[2:] == label[2:] for x in LABELS]
    return ok


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(emission, transition) weights that maximise the conditional likelihood, by adaptive gradient steps."""
    k = len(LABELS)
    emit, move, ok = np.zeros((DIMENSIONS, k)), np.zeros((k, k)), _allowed()
    start = np.array([0.0 if x[0] != "I" else -1e9 for x in LABELS])
    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    order = np.random.default_rng(4)
    for _ in range(epochs):
        for at in order.permutation(len(rows)):
            features, labels = rows[at]
            n, score, step = len(labels), emit[features].sum(1), np.where(ok, move, -1e9)
            ahead, behind = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = start + score[0]
            for t in range(1, n):
                ahead[t] = score[t] + _sum_exp(ahead[t - 1][:, None] + step, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = _sum_exp(step + score[t + 1] + behind[t + 1], 1)
            whole = _sum_exp(ahead[-1], 0)
            off = np.exp(ahead + behind - whole)
            off[np.arange(n), labels] -= 1
            turn = np.zeros((k, k))
            for t in range(1, n):
                turn += np.exp(ahead[t - 1][:, None] + step + score[t] + behind[t] - whole)
                turn[labels[t - 1], labels[t]] -= 1
            gradient = np.zeros_like(emit)
            np.add.at(gradient, features.ravel(), np.repeat(off, features.shape[1], axis=0))
            touched = np.unique(features)
            g = gradient[touched] + DECAY * emit[touched]
            seen_e[touched] += g * g
            emit[touched] -= RATE * g / np.sqrt(seen_e[touched])
            g = turn + DECAY * move
            seen_m += g * g
            move -= RATE * g / np.sqrt(seen_m)
    return emit, move


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence of token scores; sequences of like length are decoded side by side."""
    k, step = len(LABELS), np.where(_allowed(), move, -1e9)
    start = np.array([0.0 if x[0] != "I" else -1e9 for x in LABELS])
    out: list[np.ndarray] = [np.empty(0, int)] * len(scores)
    by_size = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    while by_size:
        size = len(scores[by_size[0]])
        group = [i for i in by_size if len(scores[i]) <= size * 5 // 4 + 4]
        by_size = by_size[len(group) :]
        lengths = np.array([len(scores[i]) for i in group])
        longest = int(lengths.max())
        padded = np.zeros((len(group), longest, k))
        for row, i in enumerate(group):
            padded[row, : lengths[row]] = scores[i]
        back = np.zeros((len(group), longest, k), np.int8)
        now, best = start + padded[:, 0], np.zeros((len(group), k))
        best[lengths == 1] = now[lengths == 1]
        for t in range(1, longest):
            ways = now[:, :, None] + step
            back[:, t] = ways.argmax(1)
            now = ways.max(1) + padded[:, t]
            best[lengths == t + 1] = now[lengths == t + 1]
        path, at = np.zeros((len(group), longest), int), best.argmax(1)
        for t in range(longest - 1, -1, -1):
            live = lengths > t
            path[live, t] = at[live]
            if t:
                at = np.where(live, back[np.arange(len(group)), t, at], at)
        for row, i in enumerate(group):
            out[i] = path[row, : lengths[row]]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that may hold personal data: around digits and at signs, cut at white space, melted if they touch."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - ROOM), min(len(text), m.end() + ROOM)
        if a and (s := _SPACE.search(text, a, m.start())):
            a = s.end()
        if b < len(text) and (s := text.rfind(" ", m.end(), b)) >= 0:
            b = s
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _plausible(kind: str, piece: str) -> bool:
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "email":
        signs = list(re.finditer(r"@|\bat\b", piece.lower()))
        return len(signs) == 1 and re.search(r"\w.*(?:\.|\bdot\b).*\w", piece[signs[0].end() :].lower(), re.S) is not None
    if kind == "ip":
        return _address(re.findall(r"[0-9]+", piece))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 7 <= len(digits) <= 15


def tagged_spans(texts: list[str], base: list[list[tuple[int, str, int]]], emit: np.ndarray, move: np.ndarray):
    """For each text the field's spans that are well formed and touch none of its base spans."""
    jobs, out = [], [[] for _ in texts]
    for i, text in enumerate(texts):
        for a, b in stretches(text):
            tokens, places, gaps = _split(text, a, b)
            if not tokens:
                continue
            near = np.array([bool(_ANCHOR.fullmatch(t)) for t in tokens])
            reach = np.convolve(near, np.ones(2 * REACH + 1), "same")[: len(near)] if len(near) > 2 * REACH else np.ones(len(near)) * near.any()
            score = emit[np.array(_features(tokens, gaps))].sum(1)
            score[reach < 0.5, 1:] = -1e6
            jobs.append((i, places, score))
    for (i, places, _), path in zip(jobs, viterbi([j[2] for j in jobs], move), strict=True):
        t = 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            end, kind = t + 1, LABELS[path[t]][2:]
            while end < len(path) and LABELS[path[end]] == f"I-{kind}":
                end += 1
            a, b = places[t][0], places[end - 1][1]
            if _plausible(kind, texts[i][a:b]) and all(b <= x or a >= y for x, _, y in base[i]):
                out[i].append((a, kind, b))
            t = end
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def _finder(emit: np.ndarray, move: np.ndarray):
    def run(batches):
        for batch in batches:
            texts, rest = batch["text"].fillna("").tolist(), batch.drop(columns="text")
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                base = [base_spans(t) for t in part]
                more = tagged_spans(part, base, emit, move)
                rows = [
                    (*(sum(k == kind for _, k, _ in b) for kind in KINDS), hashlib.sha256(_joined(b).encode()).hexdigest(), _joined(b + m))
                    for b, m in zip(base, more, strict=True)
                ]
                found = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
                yield found.assign(**{c: rest[c].iloc[lo : lo + 500].array for c in rest.columns})

    return run


def find_pii(docs: DataFrame, table: str = TABLE) -> DataFrame:
    """``docs`` (text and any others but it) with n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    ``spans`` lists kind:start:end of all spans by start, then kind, in code points, end exclusive; counts and digest
    cover the fixed patterns only.  Spans of the field, trained from ``table``, never touch a pattern's.  Null and
    empty texts have none.  Columns of ``docs`` with a result's name are replaced.
    """
    emit, move = train(parse_table(table))
    docs = docs.drop(*(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = with_fields(docs.drop("text").schema, f"{counts}, base_sha256 string, spans string")
    return docs.mapInPandas(_finder(emit, move), schema)
