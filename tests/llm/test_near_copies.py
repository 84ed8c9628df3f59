"""The near-dedup stage against all pairs of texts."""

import corpus_pipeline as C
import numpy as np
import pytest
from quern.llm import near_copies as N

from .conftest import table


def brute_classes(sets, least):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1) >= least and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def test_classes():
    """Sets around the bound, chains among them, with few pivots and many."""
    rng = np.random.default_rng(3)
    for spread in (0.02, 0.1, 0.2, 0.4):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * spread, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(80)]
        assert N.classes(sets, 0.8).tolist() == brute_classes([set(s.tolist()) for s in sets], 0.8)


def planted():
    """Rows, and their sets of shingles: copies with edits at similarities from about 0.5 to 1."""
    rng = np.random.default_rng(5)
    rows = [(9000, ""), (9001, " "), (9002, None), (9003, "same id, one text"), (9003, "same id and quite another text")]
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        for m in range(4):
            copy = list(words)
            for p in rng.choice(200, m * int(rng.integers(1, 6)), replace=False):
                copy[p] = f"c{rng.integers(0, 10**6)}"
            rows.append((g * 4 + m, " ".join(copy)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, t in rows for w in [(t or "").split()]]
    return rows, sets


@pytest.mark.parametrize("held", [N.HELD_SHINGLES, 300])
def test_stage(spark, monkeypatch, held):
    """Exactly the texts of 0.8 or more, and chains of them, leave one, whether components fit into a task or are dealt to many."""
    monkeypatch.setattr(N, "HELD_SHINGLES", held)
    rows, sets = planted()
    label = brute_classes(sets, 0.8)
    assert 40 < len({x for x in label if x > 4}) < 160
    want = sorted(min((rows[k][0], str(rows[k][1])) for k in range(len(rows)) if label[k] == x)[0] for x in set(label))
    got = sorted(r.doc_id for r in C.near_dedup(spark, table(spark, rows), "").collect())
    assert got == want and got.count(9003) == 2


def test_rounds_of_a_large_component(spark, monkeypatch):
    """One component of chains and crowds, far larger than a task may hold, with rows that repeat."""
    monkeypatch.setattr(N, "HELD_SHINGLES", 500)
    rng = np.random.default_rng(11)
    texts, chain = [], [f"w{x}" for x in rng.integers(0, 10**6, 100)]
    for k in range(60):
        copy = list(chain)
        for p in rng.choice(100, int(rng.integers(0, 4)), replace=False):
            copy[p] = f"c{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
        if k % 10 == 9:
            chain = copy
    keys = list(range(len(texts)))
    df = spark.createDataFrame([(7, k, len(N.shingles(t, 5)), t) for k, t in zip(keys, texts, strict=True)] * 2, "root long, k long, size long, text string")
    links = N.confirmed(df.dropDuplicates(["k"]), df, 5, 0.8).collect()
    label = {r.node: r["class"] for r in links}
    want = brute_classes([set(N.shingles(t, 5).tolist()) for t in texts], 0.8)
    groups = lambda xs: {frozenset(i for i, y in enumerate(xs) if y == x) for x in xs}
    assert groups([label.get(k, k) for k in keys]) == groups(want) and len(set(want)) > 1


def test_recall_by_similarity():
    """Of pairs at 0.8 all share a band; a much lower similarity seldom does."""
    rng = np.random.default_rng(2)

    def shared(same: int, own: int) -> float:
        hit = 0
        for _ in range(200):
            base = rng.integers(0, 2**63, same).astype(np.uint64)
            a, b = (np.unique(np.concatenate([base, rng.integers(0, 2**63, own).astype(np.uint64)])) for _ in "ab")
            hit += bool(set(N.bands(a)) & set(N.bands(b)))
        return hit / 200

    assert shared(160, 20) == 1.0 and shared(30, 135) < 0.05
