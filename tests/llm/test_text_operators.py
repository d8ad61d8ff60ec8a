"""The text operators against brute force, on ordinary and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hexvigil.llm import langid, mixing, packing, pii, plans, quality, secrets, toxicity
from hexvigil.llm.common import components, shingle_sets, word_hashes
from hexvigil.llm.minhash import near_duplicates
from tests_llm_data import SF, awkward, empty_docs, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


# Shared helpers


@given(st.lists(st.text(alphabet="aAbB é\t\n　x", max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_word_hashes_follow_the_words(texts):
    words, firsts = word_hashes(texts)
    table = str.maketrans("AB", "ab")
    expected = [WORD.findall(t.translate(table)) for t in texts]
    assert list(np.diff(firsts)) == [len(w) for w in expected]
    seen = {}
    for word, code in zip([w for ws in expected for w in ws], words.tolist(), strict=True):
        assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(200, 260)] + [(9, 9)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Near duplicates


def brute_components(rows, size, percent):
    """{doc_id: (set size, component)} by comparing all pairs of texts."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(table))
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    lists = defaultdict(list)
    for doc_id, s in sets.items():
        for gram in s:
            lists[gram].append(doc_id)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc_id, s in sets.items():
        for other, common in Counter(o for gram in s for o in lists[gram] if o < doc_id).items():
            if 100 * common >= percent * (len(s) + len(sets[other]) - common):
                a, b = sorted((find(doc_id), find(other)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_of_whole_table(spark, size):
    docs = read(spark, "documents").select("doc_id", "text")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, size).collect()}
    assert found == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], size, 80)


def test_near_duplicates_in_groups_and_short_texts(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for group in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(3, 150)))]
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = f"e{rng.integers(0, 9)}"
            rows.append((n := n + 1, " ".join(words)))
    rows += [(1000 + i, "the same boilerplate line stands in all of these " + f"own{i} " * (i % 4)) for i in range(30)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 4, 80)


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    from hexvigil.llm import minhash

    monkeypatch.setattr(minhash, "CHUNK", 8)
    monkeypatch.setattr(minhash, "BLOCK", 600)
    test_near_duplicates_in_groups_and_short_texts(spark)


def test_near_duplicates_of_awkward_rows(spark):
    rows = near_duplicates(awkward(spark), 4).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert len(rows) == awkward(spark).count()
    assert all(r["component_id"] is None and r["kept"] for r in by_id[None])
    assert by_id[2][0]["n_shingles"] == 0 and by_id[2][0]["kept"]  # null text
    assert {r["component_id"] for r in by_id[20] + by_id[21]} == {20}
    assert len(by_id[30]) == 2 and all(r["kept"] for r in by_id[30])
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_rows_that_repeat_an_id_go_by_their_text(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(7, one), (7, two), (3, one + " more"), (9, two), (9, two + " again")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter({(7, 3): 1, (7, 7): 1, (3, 3): 1, (9, 7): 2})


def test_sketches_of_equal_words():
    one, two, three = shingle_sets(["A b c d e", "a  b\tC D e", "a b"], 4)
    assert (one == two).all() and len(one) == 2 and len(three) == 1


# Mixing


def test_mixing_comes_near_targets(spark):
    rows = mixing.mix_sources(awkward(spark)).collect()
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"] for r in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(taken[s] - t) <= 2 * largest[s] for s, t in target.items())  # a repeated row counts twice
    assert set(awkward(spark).columns) <= set(mixing.mix_sources(awkward(spark)).columns)
    assert mixing.mix_sources(empty_docs(spark)).count() == 0


def test_mixing_reshapes_with_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 40:02d}") for i in range(2000)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in found:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in size if weights[s] * level >= 3 * size[s]} - capped
        if not more:
            break
        capped |= more
    for s in size:
        assert target[s] == pytest.approx(min(3 * size[s], weights[s] * level))
        assert abs(taken[s] - target[s]) <= 3.5


# Packing


def check_packed(rows, limit):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


@given(st.lists(st.integers(1, 40), max_size=200))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    used = Counter()
    for times, content in packing.pack_lengths(counts):
        assert times > 0 and sum(k * n for k, n in content.items()) <= 40
        for k, n in content.items():
            used[k] += times * n
    assert used == Counter(lengths)


def test_plan_fills_gaps_exactly():
    counts = np.zeros(101, int)
    counts[[50, 30, 20, 90, 4, 3]] = [6, 6, 6, 2, 2, 4]
    assert sum(t for t, _ in packing.pack_lengths(counts)) == -(-sum(i * n for i, n in enumerate(counts)) // 100)


def test_packing_of_awkward_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = awkward(spark).unionByName(
        spark.createDataFrame([(90, "a <|endoftext|> b", "en", "s", 1, 1, "x")], awkward(spark).schema)
    )
    rows = packing.best_fit(docs).collect()
    check_packed(rows, 2048)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    assert packing.best_fit(empty_docs(spark)).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = read(spark, "documents").select("doc_id", "text")
    rows = packing.best_fit(docs, with_ids=True).collect()
    n = check_packed(rows, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        assert ids[r["doc_id"]][-1] == 0 and tokenizer.decode(ids[r["doc_id"]][:-1], skip_special_tokens=False) == r["text"]


# Language


def test_language_of_held_out_texts(spark):
    rows = plans.op3_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in read(spark, "documents").collect()}
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {d for d in truth if held(d)}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)


def brute_labels(scores, switch):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        ways = np.where(np.eye(len(best), dtype=bool), best[None, :], best[None, :] - switch)
        back.append(ways.argmax(1))
        best = ways.max(1) + s
    return best.max()


@given(st.lists(st.integers(0, 100), min_size=1, max_size=4), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_switching_path_is_best(lengths, seed):
    rng = np.random.default_rng(seed)
    scores, firsts = rng.random((sum(lengths), 3)) * 5, np.cumsum([0, *lengths])
    labels = langid.best_labels(scores, firsts, 3.0)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b > a:
            total = scores[np.arange(a, b), labels[a:b]].sum() - 3.0 * (np.diff(labels[a:b]) != 0).sum()
            assert total == pytest.approx(brute_labels(scores[a:b], 3.0))


def test_language_spans_and_awkward_rows(spark):
    train = read(spark, "documents").filter("lang in ('en', 'de')").select("doc_id", "text", "lang")
    model = langid.learn(train)
    texts = {lang: [r["text"] for r in train.filter(f"lang = '{lang}'").limit(5).collect()] for lang in ("en", "de")}
    english, german = max(texts["en"], key=len)[:600], max(texts["de"], key=len)[:600]
    mixed = spark.createDataFrame([(1, english + " " + german)], "doc_id long, text string")
    spans = langid.identify(mixed, model).first()["spans"]
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "de" and len(spans) <= 4
    found = langid.learn_and_identify(awkward(spark)).collect()
    assert len(found) == awkward(spark).count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.learn_and_identify(empty_docs(spark)).count() == 0


# Secrets


def plain_secrets(text):
    out = [
        (m.start(), "assign", m.end())
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I)
        if len(m[2]) >= 8
    ]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


@given(st.lists(st.sampled_from(["token", "PASSWORD", " ", "=", ":", '"', "abc12345", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789", "ſecret", "x"]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_fixed_secret_patterns(parts):
    text = "".join(parts)
    assert sorted(secrets.base_spans(text)) == sorted(plain_secrets(text))


def plain_words(texts, most=secrets.LEARNED, least=secrets.LEAST):
    """The commonest words by documents, counted in plain Python; whole steps of counts."""
    import regex

    df = Counter(w for t in texts for w in set(regex.findall(secrets._WORD, (t or "").lower())))
    ordered = sorted(((n, w) for w, n in df.items() if n >= least), key=lambda x: (-x[0], x[1]))
    steps = [math.floor(math.log2(n) * 64) for n, _ in ordered]
    if len(ordered) > most:
        ordered = [x for x, s in zip(ordered, steps, strict=True) if s > steps[most]]
    return [w for _, w in ordered]


def test_words_are_ranked_by_documents(spark):
    docs = read(spark, "documents")
    texts = [r["text"] for r in docs.collect()]
    assert secrets.common_words(docs) == plain_words(texts)
    assert secrets.common_words(docs, 50, 10) == plain_words(texts, 50, 10)
    assert secrets.common_words(awkward(spark), least=2) == plain_words([r["text"] for r in awkward(spark).collect()], least=2)
    assert secrets.common_words(empty_docs(spark)) == []


def brute_bits(value, rank):
    """The cheapest of all segmentations."""
    low = value.lower()
    plain = low.translate(secrets._PLAIN)

    def piece(i, j):
        part, costs = low[i:j], []
        if j - i == 1:
            costs.append(secrets._alphabet(value[i]))
        if j - i >= 3:
            if len(set(part)) == 1:
                costs.append(1 + secrets._alphabet(part[0]) + math.log2(j - i))
            if all(x in secrets._NEXT for x in zip(part, part[1:], strict=False)):
                costs.append(1 + math.log2(len(secrets.ROWS) * 10) + math.log2(j - i))
            if place := rank.get(part) or rank.get(plain[i:j]):
                costs.append(1 + math.log2(place + 1) + (value[i:j] != part) + 2 * (part != plain[i:j]))
            m = secrets._DATE.fullmatch(part)
            if m:
                costs.append(1 + math.log2(365 * 120 if j - i > 4 else 120))
        return min(costs, default=math.inf)

    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        best[j] = min(best[i] + piece(i, j) for i in range(j))
    return best[-1]


def test_guess_cost_is_the_cheapest_segmentation():
    rng = np.random.default_rng(6)
    rank = secrets.Ranks(["qwe", "das", "aaa", "foobar", "ert"])
    parts = ["qwe", "das", "aaaa", "2019", "1990-12-24", "foobar", "Foo", "p@ss", "x", "7", "#", "ert", "asdf", "0000", "Z"]
    for _ in range(400):
        value = "".join(rng.choice(parts, rng.integers(1, 6)))
        assert secrets.guess_bits(value, rank) == pytest.approx(brute_bits(value, rank)), value


def test_prose_is_no_secret():
    for text in ("The secret is understanding your customers.", "His password is something you know", "the secret is patience"):
        assert secrets.guessed_spans(text, [], secrets.BITS) == []
    for text, value in (("the password is kT9vQ2mZ7xx", "kT9vQ2mZ7xx"), ('the password is "kTzvQqmZnxx"', "kTzvQqmZnxx"), ("password = xqzvkwjhpt", "xqzvkwjhpt")):
        assert [text[a:b] for a, _, b in secrets.guessed_spans(text, [], secrets.BITS)] == [value], text


def test_learned_words_make_values_cheap():
    value = "quarterlyreportreminder"
    assert secrets.guess_bits(value) >= secrets.BITS > secrets.guess_bits(value, secrets.Ranks(["quarterly", "report", "reminder"]))


def test_guess_cost():
    assert secrets.guess_bits("") == 0
    cheap = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "19991231", "changeme", "letmein2020"]
    dear = ["f3Kq9ZxT2mWv", "908038b7daaf91e730d2", "Tr0ub4dor&3xY!q"]
    assert max(map(secrets.guess_bits, cheap)) < secrets.BITS <= min(map(secrets.guess_bits, dear))
    assert secrets.guess_bits("a" * 100_000) < 40


def test_guessed_values_and_redaction(spark):
    text = 'x pwd = "kT9#vQ2!mZ7x" and passphrase: changeme then https://u:Zk81jQpL0w@host/ and token = "abcdef123456"'
    docs = spark.createDataFrame([(1, text, 7), (2, None, 8), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    row = secrets.scan_secrets(docs).filter("doc_id = 1").first()
    assert [text[s["start"] : s["end"]] for s in row["secrets"] if s["kind"] == "guess"] == ["kT9#vQ2!mZ7x", "Zk81jQpL0w"]
    assert row["n_assign"] == 1 and row["spans"].count("assign") == 1
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[1]["text"] == 'x pwd = "[secret]" and passphrase: changeme then https://u:[secret]@host/ and [secret]"'
    assert clean[1]["n_chars"] == len(clean[1]["text"]) and clean[2]["text"] is None and clean[3]["n_chars"] == 5


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("AWS_SECRET_ACCESS_KEY=wJ4lrXUtnFEMI7K9MDENGbPxRfiCYzz", "wJ4lrXUtnFEMI7K9MDENGbPxRfiCYzz"),
        ("DB_PASS=Xk93vLp0Zt7wQqR", "Xk93vLp0Zt7wQqR"),
        ("db_pwd: Xk93vLp0Zt7wQqR", "Xk93vLp0Zt7wQqR"),
        ("DB_PASSWORD=x!9$kQ#2vLp0Zt7w", "x!9$kQ#2vLp0Zt7w"),
        ('redisPassword: "x!9$kQ#2vLp0"', "x!9$kQ#2vLp0"),
        ("password1 = x!9$kQ#2vLp0", "x!9$kQ#2vLp0"),
        ("dbpass=Xk93vLp0Zt7wQqR", "Xk93vLp0Zt7wQqR"),
        ("spring.datasource.password.prod = x!9$kQ#2vLp0", "x!9$kQ#2vLp0"),
        ("DB_PASS=changeme", None),
        ("compass: northwesterly", None),
        ("secretary: Johannesburg", None),
        ("trespass is unconstitutional", None),
    ],
)
def test_credential_names_inside_longer_ones(text, value):
    base = secrets.base_spans(text)
    assert base == [] and [text[a:b] for a, _, b in secrets.guessed_spans(text, base, secrets.BITS)] == ([value] if value else [])


def test_secret_scan_of_table_and_awkward_rows(spark):
    docs = read(spark, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in plans.op7_secrets(spark, SF).collect()}
    for d in docs:
        base = sorted(plain_secrets(d["text"]), key=lambda s: (s[0], secrets.KINDS.index(s[1])))
        assert found[d["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    rows = secrets.scan_secrets(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count() and set(awkward(spark).columns) - {"spans"} <= set(rows[0].asDict())
    assert secrets.scan_secrets(empty_docs(spark)).count() == 0


# Personal data


def plain_pii(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii._luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


@given(st.text(alphabet="a.@+-( )0128 5", max_size=60))
@settings(max_examples=300, deadline=None)
def test_fixed_pii_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_pii(text))


def test_field_learns_and_generalises():
    rows = pii.parse_table()
    emit, move = pii.train(rows)
    paths = pii.viterbi([emit[f].sum(1) for f, _ in rows], move)
    assert sum((p == y).all() for p, (_, y) in zip(paths, rows, strict=True)) >= len(rows) - 1
    texts = ["please call (212) 555-0187 or write to joe at corp dot com", "in 2003 we had 400 users and 3 500 000 hits", "see 192[.]0[.]2[.]1 there"]
    found = pii.tagged_spans(texts, [pii.base_spans(t) for t in texts], emit, move)
    assert {(k, texts[0][a:b]) for a, k, b in found[0]} >= {("phone", "(212) 555-0187")}
    assert not found[1] and [k for _, k, _ in found[2]] == ["ip"]


def test_viterbi_is_best():
    rng = np.random.default_rng(2)
    scores = [rng.standard_normal((n, len(pii.LABELS))) for n in (1, 2, 3, 3, 4)]
    move = rng.standard_normal((len(pii.LABELS),) * 2)
    ok = pii._allowed()
    for s, path in zip(scores, pii.viterbi(scores, move), strict=True):
        best = -np.inf
        for code in np.ndindex(*([len(pii.LABELS)] * len(s))):
            if pii.LABELS[code[0]][0] != "I" and all(ok[a, b] for a, b in zip(code[:-1], code[1:], strict=True)):
                best = max(best, s[range(len(s)), code].sum() + sum(move[a, b] for a, b in zip(code[:-1], code[1:], strict=True)))
        assert s[range(len(s)), path].sum() + sum(move[a, b] for a, b in zip(path[:-1], path[1:], strict=True)) == pytest.approx(best)


def test_pii_of_table_and_awkward_rows(spark):
    docs = read(spark, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in plans.op4_pii(spark, SF).collect()}
    for d in docs:
        base = sorted(plain_pii(d["text"]), key=lambda s: (s[0], pii.KINDS.index(s[1])))
        row = found[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(row["spans"].split(","))
    assert pii.find_pii(awkward(spark)).count() == awkward(spark).count()
    assert pii.find_pii(empty_docs(spark)).count() == 0


#: Sentences that the field hasn't seen: other words and numbers than its table's, and near misses without any.
UNSEEN = """
write to [email anna ( dot ) schmidt ( at ) firma ( dot ) de] today
[email peter dot jones at mail dot example dot org] answers fast
reach [email m.meier (at) web.de] or his desk
contact [email sales [at] shop [dot] com] for offers
[email lucy_k at post dot net] is her address
mailto [email bob - the - builder @ site . org] please
email [email jane.roe at uni dot edu] before noon
send it to [email x.y ( at ) z . com] now
host [ip 10 . 20 . 30 . 40] does not answer
the gate at [ip 192 . 168 . 7 . 1] is closed
block [ip 172 [.] 16 [.] 0 [.] 9] at once
server [ip 8 (dot) 8 (dot) 4 (dot) 4] is public
card [card 5105 . 1051 . 0510 . 5100] was declined
visa [card 4111 / 1111 / 1111 / 1111] expires soon
pay with [card 4012 _ 8888 _ 8888 _ 1881] today
phone [phone ( 089 ) 1234 567] in munich
call [phone 555 . 123 . 4567] tonight
tel [phone 0664 / 123 45 67] abends
mobile [phone 07911 123 456] on weekends
ring [phone ( 212 ) 555 0142] twice
llame al [phone 93 412 33 22] hoy
téléphone [phone 04 78 12 34 56] le matin
order number 555 867 5309 shipped
ticket 4471 223 118 is closed
parcel 0034 9912 7781 left the depot
account 12 345 678 was audited
the meeting at 10 dot com boom starts soon
look at the dot on the map at noon
version 10 . 2 . 3 was released in 2021
the ratio is 3 . 5 to 1 at best
between 2010 and 2015 some 4 500 000 people moved
his serial 8812 4410 2291 was scratched
invoice number 2021 0045 7781 is due
in room 212 555 people waited
see chapter 10 . 20 . 30 of the book
he arrived at dot net conference late
the price rose from 1 299 to 1 499 dollars
reference 030 1234567 was filed
"""


def test_field_on_unseen_sentences():
    """Precision and recall of the spans that the field adds, by kind; a span counts if it overlaps one of its kind."""
    emit, move = pii.train(pii.parse_table())
    mark = re.compile(rf"\[({'|'.join(pii.KINDS)}) ((?:[^\[\]]|\[(?:at|dot|\.)\])*)\]")
    right, wrong, missed = Counter(), Counter(), Counter()
    for line in filter(None, UNSEEN.split("\n")):
        plain, spans, last = "", [], 0
        for m in mark.finditer(line):
            plain += line[last : m.start()]
            spans.append((len(plain), m[1], len(plain) + len(m[2])))
            plain += m[2]
            last = m.end()
        plain += line[last:]
        base = pii.base_spans(plain)
        found = base + pii.tagged_spans([plain], [base], emit, move)[0]
        same = lambda x, y: x[1] == y[1] and x[0] < y[2] and y[0] < x[2]
        for x in found:
            (right if any(same(x, y) for y in spans) else wrong)[x[1]] += 1
        missed.update(y[1] for y in spans if not any(same(x, y) for x in found))
    assert sum(right.values()) >= 0.8 * (sum(right.values()) + sum(missed.values())), missed
    assert sum(wrong.values()) <= 0.1 * sum(right.values()), wrong


# Classifiers


@pytest.mark.parametrize(("query", "label", "least"), [(plans.op6_toxicity, "toxic", 0.80), (plans.op9_quality, "quality", 0.85)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    sf = SF.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= least * len(out)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_awkward_rows(spark, score):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 0), (3, None, None), (4, 7, 7), (5, 1, 1)], "doc_id long, quality int, toxic int"
    )
    rows = score(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in score(awkward(spark), labels.limit(0)).collect())
    assert score(empty_docs(spark), labels).count() == 0


def test_toxic_words_move_the_score(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("tor", "lem", "quis", "ban") for b in ("ana", "ire", "olu") for c in ("t", "ns", "re")]
    plain = [" ".join(rng.choice(words, 120)) for _ in range(200)]
    bad = [f"{t[:200]} scoundrel {t[200:]} villainous" for t in plain[:80]]
    model = toxicity.fit(pd.DataFrame({"text": plain[80:] + bad, "label": [0] * 120 + [1] * 80}))
    features = toxicity._measure(model.ordinary, model.toxic)
    clean, toxic = (np.array(features(t)) @ model.weights[:-1] + model.weights[-1] for t in (plain[0], "what a villainous scoundrel " + plain[0]))
    assert clean < 0 < toxic


def test_features_come_from_compression_lengths_alone():
    """Words of the toxic dictionary that the ordinary one compresses as well give nothing: no word is counted as such."""
    model = toxicity.Model(b" scoundrel villainous lorem ipsum dolor amet", b" scoundrel villainous ", np.zeros(16))
    features = toxicity._measure(model.ordinary, model.toxic)
    text = "scoundrel villainous lorem ipsum"
    assert max(features(text)) <= max(features("lorem ipsum dolor amet"))
    margins = toxicity._measure(b" lorem ipsum dolor amet", model.toxic)
    assert margins("lorem scoundrel")[-toxicity.LARGEST :][0] >= 4 and max(margins("lorem ipsum")) <= 1
    plain, both = (toxicity._compressor(d) for d in (b" lorem ipsum dolor amet", b" lorem ipsum dolor amet" + model.toxic))
    x = toxicity.window("scoundrel")
    assert margins("scoundrel")[-toxicity.LARGEST] == len(plain.compress(x)) - len(both.compress(x))


def test_margins_stay_right_when_the_kept_ones_start_anew(monkeypatch):
    model = toxicity.Model(b" lorem ipsum", b" scoundrel villainous ", np.zeros(16))
    texts = ["lorem scoundrel", "ipsum", "villainous scoundrel lorem", "a b c d e scoundrel"]
    expected = [toxicity._measure(model.ordinary, model.toxic)(t) for t in texts]
    monkeypatch.setattr(toxicity, "KEPT", 2)
    features = toxicity._measure(model.ordinary, model.toxic)
    assert [features(t) for t in texts] == expected


def test_rarer_toxic_vocabularies_are_kept():
    rng = np.random.default_rng(4)
    plain = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"], 60)) for _ in range(900)]
    common, rare = ["scoundrel", "villainous"], ["grobzz", "flegmaq", "hurlokk"]
    bad = [f"{t} {' '.join(common)}" for t in plain[:100]] + [f"{t} {' '.join(rng.choice(rare, 2, False))}" for t in plain[100:112]]
    assert set(toxicity.contrast(bad, plain[112:])) == {*common, *rare}


def test_late_ordinary_documents_reach_the_dictionary():
    import pandas as pd

    late = "zanthoxylum quorbellate vexillarium"
    texts = ["lorem ipsum dolor amet consectetur"] * 2000 + [f"{late} {i % 7 * 'x'}" for i in range(2000)] + ["scoundrel"] * 40
    model = toxicity.fit(pd.DataFrame({"text": texts, "label": [0] * 4000 + [1] * 40}))
    assert b"quorbellate" in model.ordinary


def test_toxic_recall_in_each_language(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = plans.op6_toxicity(spark, sf).filter("held_out").join(docs, "doc_id").join(truth, "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == 1]
        assert sum(toxic) >= 0.75 * len(toxic) > 0, (lang, sum(toxic), len(toxic))
    found = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(found) >= 0.8 * len(found)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.01 * sum(r["toxic"] == 0 for r in rows)
