"""The pipeline against a plain version of its stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hexvigil.llm import langid, secrets
from test_text_operators import brute_components, check_packed, plain_words
from tests_llm_data import SF, read

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def mixed(rows):
    """{doc_id: copies} by sorting each source's documents by hash."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    mark = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) for d, _, _ in rows}
    of = defaultdict(list)
    for d, _, s in rows:
        of[s].append(d)
    total = {s: sum(size[d] for d in ds) for s, ds in of.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(of, key=lambda s: (s is None, s or "")))}
    level, full = 0.0, set()
    while True:
        rest = [s for s in of if s not in full]
        if not rest:
            break
        level = float(sum(total.values()) - 3 * sum(total[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if weight[s] * level >= 3 * total[s]}
        if not more:
            break
        full |= more
    out = {}
    for s, ds in of.items():
        target = 3.0 * total[s] if s in full else weight[s] * level
        times = int(target // total[s]) if total[s] else 0
        budget, before = target - times * total[s], 0
        for d in sorted(ds, key=mark.get):
            out[d] = times + (size[d] > 0 and before + size[d] / 2 < budget)
            before += size[d]
    return out


def expected(rows, keeps):
    """Pieces (doc_id, piece, start, length, crc) of what the stages leave of (doc_id, text, lang, source)."""
    rows = [r for r in rows if r[0] in keeps]
    component = brute_components([(d, t) for d, t, _, _ in rows], 5, 80)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    clean, rank = [], secrets.Ranks(plain_words([t for _, t, _, _ in rows]))
    for d, t, _, s in rows:
        found = secrets.base_spans(t)
        out, at = "", 0
        for a, _, b in sorted(found + secrets.guessed_spans(t, found, secrets.BITS, rank)):
            out, at = (out + t[at:a] + "[secret]" if a >= at else out), max(at, b)
        clean.append((d, out + t[at:], s))
    copies = mixed(clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for d, t, _ in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if copies[d]:
                pieces[d, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += copies[d]
    return pieces


def test_pipeline_over_the_table(spark):
    docs = read(spark, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in langid.learn_and_identify(docs).collect() if r["lang_pred"] != "und"}
    assert len(kept) >= 0.98 * len(rows)
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected(rows, kept)
    check_packed(found, 2048)


def test_stages_keep_columns_and_stand_awkward_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer who owns the field"
    rows = [(i, f"{text} number {i} " + " ".join(f"w{i * 31 + k}" for k in range(20)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, text, "en", "s0", 1), (100, text, "en", "s0", 1), (101, text + " ", "en", None, 1), (102, None, None, None, None)]
    rows += [(103, "", "en", "s1", 0), (104, "12 34 %%", "en", "s1", 8), (None, "a row without an id in plain english words", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    left = corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in left)
    assert ids[100] == 1 and ids[101] == 0 and ids[None] == 1 and all(ids[i] == 1 for i in range(30))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), 2048)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_one_id_are_judged_by_their_text(spark, tmp_path):
    """A clean text stays though another text of its id is a copy; of near copies under one id one stays."""
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (8, "x y z"), (9, "c " + a[:20]), (9, "c " + a[:20]), (9, "d e f g h i")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    left = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect())
    assert left == sorted([(1, a), (5, b), (8, "x y z"), (9, "c " + a[:20]), (9, "d e f g h i")])
    near = [(3, a), (3, a + " end"), (3, "end " + a), (4, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in near], COLUMNS)
    left = corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect()
    assert len(left) == 1 and left[0]["doc_id"] == 3


def test_columns_named_as_results_pass_unchanged(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    names = "score spans size target times taken source_size threshold held_out lang_pred digest grp kept given_score _copy component_id".split()
    schema = f"{COLUMNS}, {', '.join(f'`{n}` string' for n in names)}"
    rows = [(i, f"{text} {i} " + " ".join(f"w{i * 31 + k}" for k in range(20)), "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name


def test_mixed_languages_stay(spark, tmp_path):
    """Three languages in equal parts: none has half of the letters, yet the notice stays; digits alone go."""
    parts = {r["lang"]: r["text"] for r in read(spark, "documents").filter("length(text) > 400").collect()}
    mixed = " ".join(parts[k][:300] for k in ("en", "de", "fr"))
    docs = read(spark, "documents").limit(0).unionByName(
        spark.createDataFrame([(10**9, mixed, "en", "s", 1), (10**9 + 1, "12 34", "en", "s", 1)], COLUMNS)
    ).unionByName(read(spark, "documents").filter("text is not null"))
    ids = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert 10**9 in ids and 10**9 + 1 not in ids
