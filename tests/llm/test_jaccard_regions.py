"""Regions of the Jaccard join: every distance is one to a pivot, dense groups stay near linear, equal names stay apart."""

from __future__ import annotations

import random

import numpy as np

from linkweir.llm import jaccard_join

DOCS = "doc_id long, text string"


def counted(monkeypatch):
    """Records the size of every computation of distances, and the pairs of a pivot and a member that are linked."""
    seen = []
    real = jaccard_join.shared_with

    def shared_with(centers, sets):
        seen.append((len(centers), len(sets)))
        return real(centers, sets)

    monkeypatch.setattr(jaccard_join, "shared_with", shared_with)
    return seen


def near_copies(rng, n, size=200, edits=3):
    base = rng.choice(10**6, size, replace=False)
    out = []
    for _ in range(n):
        x = base.copy()
        x[rng.choice(size, edits, replace=False)] = rng.integers(10**6, 10**9, edits)
        out.append(np.unique(x))
    return out


def test_even_two_members_meet_by_a_pivot(monkeypatch):
    seen = counted(monkeypatch)
    a = np.arange(100)
    assert [sorted(p) for p in jaccard_join.join_region([a, a[:95]], np.zeros(2, bool), 90, 100)] == [[0, 1]]
    assert jaccard_join.join_region([a, a[:80]], np.zeros(2, bool), 90, 100) == []
    assert seen == [(1, 2), (1, 2)]


def test_a_dense_group_needs_few_distances(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (200, 800, 3200):
        seen = counted(monkeypatch)
        pairs = jaccard_join.join_region(near_copies(rng, n), np.zeros(n, bool), 90, 100)
        assert len(pairs) == n - 1
        assert sum(c * m for c, m in seen) <= 2 * jaccard_join.PIVOTS * n


def test_unlike_members_are_parted_or_pivoted_one_by_one():
    rng = np.random.default_rng(4)
    chain = [np.arange(i, i + 100) for i in range(0, 400, 5)]  # each linked with the next only
    far = [rng.integers(10**6, 10**9, 100) for _ in range(50)]
    shared = [np.concatenate([np.arange(5000, 5060), rng.integers(10**6, 10**9, 40)]) for _ in range(120)]  # alike, and never enough
    sets = [np.unique(x) for x in chain + far + shared]
    order = rng.permutation(len(sets)).tolist()
    pairs = {frozenset((order[a], order[b])) for a, b in jaccard_join.join_region([sets[i] for i in order], np.zeros(len(sets), bool), 90, 100)}
    assert pairs == {frozenset((i, i + 1)) for i in range(len(chain) - 1)}


def test_members_known_to_be_linked_are_not_tested_with_one_another(monkeypatch):
    rng = np.random.default_rng(5)
    sets, done = near_copies(rng, 300) + near_copies(rng, 2), np.array([True] * 300 + [False] * 2)
    seen = counted(monkeypatch)
    assert [sorted(p) for p in jaccard_join.join_region(sets, done, 90, 100)] == [[300, 301]]
    assert sum(c * m for c, m in seen) <= 4 * len(sets)


def test_a_ring_beyond_a_tasks_bound_goes_to_pivots_uncompared(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(f"y{i}-{j}" for j in range(60))) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, DOCS), 1, 90, 100).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in texts}


def test_sets_of_one_name_get_names_of_their_own(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 80)], "doc_id long, key long, check long")
    found = jaccard_join._renamed(rows)
    assert set(found) == {(7, 70), (7, 71)} and len(set(found.values())) == 2 and 7 not in found.values()
    texts = [(i, f"{'a b c d e f g h i j k l m n o p q r s t' if i < 4 else f'u{i} v'} {i % 2}") for i in range(8)]
    plain = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, DOCS), 1, 90, 100).collect()}
    one = jaccard_join.shingle_set(texts[0][1], 1, jaccard_join._WordHashes())
    monkeypatch.setattr(jaccard_join, "_renamed", lambda rows: {(jaccard_join._name(one), jaccard_join._check(one)): 12345})
    again = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, DOCS), 1, 90, 100).collect()}
    assert plain == again == {i: 0 if i < 4 else i for i in range(8)}
