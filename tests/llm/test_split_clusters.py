"""Clusters of several blocks: pivots first, then the rest against every block."""

import random

import numpy as np
import pytest

from rivulet.llm import hyperminhash


def by_hand(rows, k, num):
    def shingles(t):
        w = t.split()
        return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))

    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("block", [250, 2500, 1 << 17])
def test_chains_and_stars(spark, block, monkeypatch):
    monkeypatch.setattr(hyperminhash, "PIVOTS", 2)
    monkeypatch.setattr(hyperminhash, "FEW_BLOCKS", 3)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    rows = []
    long = [word() for _ in range(700)]
    for i in range(70):  # neighbours share 92 of 100 windows, the next but one 84
        rows.append((1000 - i, " ".join(long[8 * i:8 * i + 102])))
    star = [word() for _ in range(120)]
    for i in range(60):
        v = list(star)
        v[rng.randrange(len(v))] = f"x{i}"
        rows.append((2000 + i, " ".join(v)))
    for i in range(30):  # alike enough to be candidates, not enough to be linked
        v = list(star)
        for j in range(2, 120, 24):
            v[j] = word()
        rows.append((3000 + i, " ".join(v)))
    rng.shuffle(rows)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100, block=block).collect()
    want = by_hand(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) and max(want.values()) > 2000


def test_links_between_parts_only():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.sort(np.concatenate((base[:380], rng.integers(0, 1 << 63, 20).astype(np.uint64)))) for _ in range(5)] + [np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))]
    size = np.array([len(s) for s in sets])
    regs = hyperminhash.registers(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))))
    part = np.array([7, 7, 7, 9, 9, 11])
    one, yes = np.zeros(6, int), lambda i, j: True
    got = hyperminhash.missing_links(np.arange(6) * 10, size, regs, part, one, 80, 100, yes)
    assert len(got) == 1 and {part[int(x) // 10] for x in got[0]} == {7, 9}
    assert len(hyperminhash.missing_links(np.arange(6), size, regs, one, one, 80, 100, yes)) == 0
    each = np.arange(6)
    assert len(hyperminhash.missing_links(each, size, regs, each, one, 80, 100, yes)) == 4
    got = hyperminhash.missing_links(each, size, regs, each, np.array([0, 0, 0, 0, 1, 1]), 80, 100, yes)
    assert len(got) == 4 and all((a < 4) != (b < 4) for a, b in got.tolist())  # by way of the other side
