"""The vector operators against brute force, on ordinary and awkward rows."""

from collections import Counter

import numpy as np
import pytest

from hexvigil.llm import ann, vector_dedup
from hexvigil.llm.vectors import local_roots
from tests_llm_data import read

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(ids, vectors, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


def recall(found, expected):
    hits = total = 0
    for q, near in expected.items():
        least = near[-1][1] - 1e-9 if near else 0
        total += len(near)
        hits += sum(s >= least for _, s in found.get(q, [])[: len(near)])
    return hits / total


def collected(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall_on_the_table(spark):
    table = read(spark, "embeddings")
    rows = table.orderBy("vec_id").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found, expected = collected(ann.nearest(table).collect()), brute_nearest(ids, vectors)
    assert recall(found, expected) >= 0.9 and set(found) == set(expected)
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        own = vectors[ids == q][0]
        assert all(s == pytest.approx(float(vectors[ids == i][0] @ own), abs=1e-12) for i, s in near)


def test_norms_copies_and_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 12)) * rng.uniform(0.2, 4, (400, 1))
    base[50:90] = base[49]  # more copies than a result holds
    base = base.astype(np.float32)
    rows = [(i, base[i].tolist(), i % 3) for i in range(400)]
    rows += [(500, None, 1), (520, [0.0] * 12, 1), (540, [float("nan")] * 12, 1), (560, [None] + [1.0] * 11, 1), (580, [1.0] * 5, 1)]
    rows += [(600, [float("inf")] + [1.0] * 11, 1), (None, [1.0] * 12, 1), rows[20], rows[7]]
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "score")
    found = collected(ann.nearest(table).collect())
    expected = brute_nearest(np.arange(400), base.astype(float))
    assert set(found) == set(expected)
    assert recall(found, expected) >= 0.9
    for q in (60, 80):  # of equal vectors the smallest other ids
        copies = [[i for i, _ in near[q] if 49 <= i < 90] for near in (found, expected)]
        assert copies[0] == copies[1] == sorted(copies[0])
    small = collected(ann.nearest(table.filter("vec_id in (0, 1, 2)")).collect())
    assert {i for i, _ in small[0]} == {1, 2}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def clustered(n, rng):
    """Unit vectors in clusters of about 40."""
    centres = rng.standard_normal((n // 40, 16))
    x = centres[np.arange(n) % len(centres)] + 0.1 * rng.standard_normal((n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_windows_follow_the_data_not_the_table(spark, monkeypatch):
    """In clusters a few blocks suffice at any size: what a row and a query are shuffled for stays the same."""
    rng, chosen, dealt = np.random.default_rng(12), [], []
    pick, deal = ann.windows, ann._dealer
    monkeypatch.setattr(ann, "windows", lambda *a, **k: chosen.append(pick(*a, **k)) or chosen[-1])
    monkeypatch.setattr(ann, "_dealer", lambda edges, subs, chunks, reach: dealt.append((len(edges), subs, chunks, reach)) or deal(edges, subs, chunks, reach))
    for n in (2000, 8000):
        x = clustered(n, rng)
        table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
        found = collected(ann.nearest(table, block_rows=64).collect())
        assert recall(found, brute_nearest(np.arange(n), x)) >= 0.9
    copies = [o * chunks + o * min(2 * reach + 1, 10**9) * subs / 20 for o, subs, chunks, reach in dealt]
    assert copies[1] <= 1.5 * copies[0] and all(share >= ann.TARGET for *_, share in chosen)
    blocks, (o, reach, _) = 8000 / 64, chosen[1]
    assert o * (2 * reach + 1) <= 0.5 * blocks


def test_isotropic_vectors_take_no_more_products_than_all(spark, monkeypatch):
    rng, dealt, deal = np.random.default_rng(13), [], ann._dealer
    monkeypatch.setattr(ann, "_dealer", lambda edges, subs, chunks, reach: dealt.append((edges.shape, reach)) or deal(edges, subs, chunks, reach))
    x = rng.standard_normal((1500, 48))
    found = collected(ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), block_rows=50).collect())
    assert recall(found, brute_nearest(np.arange(1500), x)) >= 0.9
    (orderings, cuts), reach = dealt[0]
    assert orderings * min(2 * reach + 1, cuts + 1) <= cuts + 1


def brute_links(rows, cosine=0.93):
    part = [
        (i, r) for i, r in enumerate(rows)
        if r[0] is not None and r[1] and r[2] is not None and len(r[1]) == 12 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])
    ]
    unit = np.array([np.array(r[1], np.float32).astype(float) for _, r in part])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for _, r in part])
    linked = (unit @ unit.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    ids, root = np.array([r[0] for _, r in part]), local_roots(linked)
    out = Counter()
    for i, _ in enumerate(part):
        out[int(ids[i]), int(linked[i].sum()), int(ids[root == root[i]].min())] += 1
    known = {i for i, _ in part}
    for i, r in enumerate(rows):
        if i not in known:
            out[r[0], 0, r[0]] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_links_in_groups_of_copies(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_dedup, "SLICE", 64)
        monkeypatch.setattr(vector_dedup, "BLOCK", 16)
        monkeypatch.setattr(vector_dedup, "BUNDLE", 32)
    rng = np.random.default_rng(8)
    vectors = [rng.standard_normal(12) for _ in range(300)]
    for at in (0, 1, 2):
        vectors += [vectors[at] + rng.standard_normal(12) * 0.12 * (1 + at) for _ in range(60)]
    vectors += [vectors[3]] * 40 + [vectors[3] * 2.0] * 3
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i) % 2 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 1), (903, [None] + [1.0] * 11, 0), (904, [1.0] * 5, 1)]
    rows += [(905, [1e30] + [1.0] * 11, 1), (None, [1.0] * 12, 1), rows[1], rows[300]]
    found = vector_dedup.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in found)


def test_links_in_a_label_of_many_windows_off_the_origin(spark):
    rng, n, pairs, mean, cosine = np.random.default_rng(8), 3000, 150, 0.8, 0.935
    z = rng.standard_normal((n, 63))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    near, rho = rng.standard_normal((pairs, 63)), (cosine - mean) / (1 - mean)
    near -= (near * z[:pairs]).sum(1, keepdims=True) * z[:pairs]
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    z[pairs : 2 * pairs] = rho * z[:pairs] + np.sqrt(1 - rho * rho) * near
    x = np.c_[np.full(n, np.sqrt(mean)), np.sqrt(1 - mean) * z] @ np.linalg.qr(rng.standard_normal((64, 64)))[0]
    links = (x @ x.T >= 0.93).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    found = {r["vec_id"]: r["n_links"] for r in vector_dedup.link_vectors(rows, window=16).collect()}
    assert links.sum() >= 2 * pairs and sum(found.values()) >= 0.99 * links.sum()


def test_links_of_empty_table(spark):
    assert vector_dedup.link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
