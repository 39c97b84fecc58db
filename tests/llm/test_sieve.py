"""The similarity join within fragments, and the far pass that rests on it, against plain versions."""

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from voxelspark.llm import ngram_join, sieve


def made_sets(seed, n, kinds=4, words=40, size=25, lost=0.1):
    """Sets near a few others, with n-grams of their own."""
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, words, rng.integers(1, size))) for _ in range(kinds)]
    sets = []
    for _ in range(n):
        b = base[rng.integers(kinds)]
        x = np.union1d(b[rng.random(len(b)) > lost], rng.integers(1000, 1060, rng.integers(0, 3)))
        sets.append(x.astype(np.uint64) if len(x) else np.array([1], np.uint64))
    return sets, rng.integers(0, max(n // 2, 1), n)


@pytest.mark.parametrize("seed", range(60))
def test_similar_segments_against_all_pairs(monkeypatch, seed):
    percent, n = (50, 80, 85)[seed % 3], 1 + seed % 37
    monkeypatch.setattr(sieve, "BLOCK", (1, 20, 1_000_000)[seed // 3 % 3])
    sets, labels = made_sets(seed, n)
    ids, own = np.arange(n) * 7 - 20, np.array([len(x) for x in sets])
    pairs = itertools.combinations(range(n), 2)
    close = [(i, j) for i, j in pairs if labels[i] != labels[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
    want = {tuple(sorted((tuple(sets[i]), tuple(sets[j])))) for i, j in close}
    s = sieve.read(ids, own, labels, np.concatenate(sets), percent)
    rank = np.lexsort((ids, sieve.mix(ids.view(np.uint64)), own))
    for direct in (True, False):
        found = [(rank[a], rank[b]) for x, y in sieve.similar(s, percent, n, direct) for a, b in zip(x, y, strict=True)]
        assert {tuple(sorted((tuple(sets[a]), tuple(sets[b])))) for a, b in found} == want


def groups(table, percent):
    """Label -> smallest label of its group, and the number of slices."""
    out = sieve.sift(percent)(table)
    edges, slices = [(r["a"], r["b"]) for r in out.to_pylist() if r["slice"] < 0], 0
    for k in range(out.num_rows):
        if out.column("slice")[k].as_py() >= 0:
            found, slices = sieve.sift_slice(percent)(out.slice(k, 1)), slices + 1
            edges += zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)
    above = {x: x for e in edges for x in e}
    for _ in above:
        for a, b in edges:
            above[a] = above[b] = min(above[a], above[b])
    return above, slices


@pytest.mark.parametrize("seed", range(8))
def test_slices_find_what_the_whole_finds(monkeypatch, seed):
    sets, labels = made_sets(seed, 60, kinds=6, words=200, size=60, lost=0.07)
    table = pa.table({"fragment": pa.array([0] * 60, pa.int32()), "id": np.arange(60) * 31 - 400, "keys": pa.array([x.tobytes() for x in sets], pa.binary()), "label": labels * 5 - 50})
    found = []
    for work, look_up in itertools.product((5, 200, 10**9), (0.001, 8, 1e6)):
        monkeypatch.setattr(sieve, "SLICE_WORK", work)
        monkeypatch.setattr(sieve, "LOOK_UP", look_up)
        found.append(groups(table, 80))
    assert found[0][0] and all(g == found[0][0] for g, _ in found)
    assert found[0][1] > 1 and found[-1][1] == 0


def test_segments_of_one_label_only():
    table = pa.table({"fragment": pa.array([0, 0], pa.int32()), "id": [4, 9], "keys": pa.array([np.arange(5, dtype=np.uint64).tobytes()] * 2, pa.binary()), "label": [4, 4]})
    assert sieve.sift(85)(table).num_rows == 0


@pytest.mark.parametrize("work", [20, 50_000_000])
def test_documents_of_common_passages(spark, monkeypatch, work):
    """Documents recombined from passages, a few of them with all passages but one in common; nearly all lists are long."""
    monkeypatch.setattr(sieve, "SLICE_WORK", work)
    r = random.Random(4)
    passages = [" ".join(f"w{r.randrange(900)}" for _ in range(12)) for _ in range(20)]
    chosen = [r.sample(range(20), 9) for _ in range(50)]
    chosen += [[*c[:8], r.randrange(20)] for c in chosen[:25]] + [c[::-1] for c in chosen[:5]]
    made = [(i, "\n".join(passages[k] for k in c)) for i, c in enumerate(chosen)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(brute.table(spark, made), 4, 75, window=1).collect()}
    want = brute.components(made, 4, 75)
    assert got == want and any(i != c for i, (_, c) in want.items())


def test_far_pass_in_small_groups(spark, monkeypatch):
    """Bands of many fragments, clusters that are joined whole, and larger ones whose partial overlaps are summed."""
    r = random.Random(9)
    made, bases = [], [[f"{k}w{i}" for i in range(60 + 40 * k)] for k in range(3)]
    for i in range(90):
        w = list(bases[i % 3])
        for _ in range(r.randrange(2 + 3 * (i % 3))):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        made.append((i, " ".join(w)))
    for most in (40, 1500, 4000):
        monkeypatch.setattr(ngram_join, "FRAGMENT_LEFT", most)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(brute.table(spark, made), 4, 80, window=1).collect()}
        assert got == brute.components(made, 4, 80)


def test_far_tasks_hold_a_slice_or_a_block_at_a_time(monkeypatch):
    """Slices leave the task one by one, and partial overlaps by blocks of pairs; before, all of them waited in the task."""
    sets, _ = made_sets(3, 60, kinds=2, lost=0.05)
    n = np.array([len(x) for x in sets])
    group = {"key": [4] * 60, "parts": [2] * 60, "fragment": pa.array([1] * 60, pa.int32()), "id": np.arange(60), "n": n, "label": np.arange(60), "keys": pa.array([x.tobytes() for x in sets], pa.binary())}
    batches = pa.table(group).to_batches()
    monkeypatch.setattr(sieve, "SLICE_WORK", 5)
    slices = list(sieve.sift_groups(80)(iter(batches)))
    assert len(slices) > 5 and all(b.num_rows == 1 for b in slices) and {(b["key"][0].as_py(), b["parts"][0].as_py()) for b in slices} == {(4, 2)}
    monkeypatch.setattr(sieve, "BLOCK", 20)
    pairs = lambda b: [(x, y, k) for r in b.to_pylist() for x, y, k in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("a", np.int64), ("b", np.int64), ("overlap", np.uint32))), strict=True)]
    monkeypatch.setattr(ngram_join, "SENT", 30)
    few = [pairs(b) for b in ngram_join._far_overlaps(80, 3)(iter(batches))]
    monkeypatch.setattr(ngram_join, "SENT", 10**6)
    whole = [pairs(b) for b in ngram_join._far_overlaps(80, 3)(iter(batches))]
    assert len(whole) == 1 and len(few) > 5 and max(map(len, few)) < 30 + 60 and sorted(sum(few, [])) == sorted(whole[0])
    near = [pairs(b) for b in ngram_join._far_overlaps(80, 3)(iter(batches))][0]
    assert all(k == len(np.intersect1d(sets[a], sets[b])) for a, b, k in near)
