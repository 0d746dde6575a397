"""The pruned scorer against full multiplication."""

import numpy as np
import pytest

from rivulet.operators import factors, scoring


def by_hand(u, bu, v, bi, seen, n):
    s = u @ v.T + bu[:, None] + bi
    out = []
    for r in range(len(u)):
        free = [c for c in range(len(v)) if (r, c) not in seen]
        best = sorted(free, key=lambda c: (scoring.rank_keys(s[r:r + 1, c])[0], c))[:n]
        out.append(([(c, s[r, c]) for c in best], min((s[r, c] for c in free), default=np.inf), max((s[r, c] for c in free), default=-np.inf)))
    return out


@pytest.mark.parametrize("spread,ties,n", [(0.0, False, 3), (3.0, False, 5), (3.0, True, 2), (1.0, True, 50)])
def test_rows_and_ends_equal_full_scores(spread, ties, n, monkeypatch):
    monkeypatch.setattr(scoring, "FIRST_BLOCK", 4)
    monkeypatch.setattr(scoring, "NEXT_BLOCK", 7)
    rng = np.random.default_rng(int(spread * 10) + n)
    for trial in range(12):
        m, k, r = 9, int(rng.integers(1, 60)), 4
        u, v = rng.normal(size=(m, r)), rng.normal(size=(k, r)) * np.exp(spread * rng.normal(size=(k, 1)))
        if ties:
            u, v = np.round(u), np.round(v)
        bu, bi = rng.normal(size=m), (np.round(rng.normal(size=k)) if ties else 0.1 * rng.normal(size=k))
        u[0] = 0
        seen = {(int(rng.integers(m)), int(rng.integers(k))) for _ in range(40)} | {(1, c) for c in range(k)}
        row, pos = np.array([x[0] for x in sorted(seen)]), np.array([x[1] for x in sorted(seen)])
        got = scoring.ItemBlock(v, bi).best_unseen(u, bu, row, pos, n)
        for i, (best, lo, hi) in enumerate(by_hand(u, bu, v, bi, seen, n)):
            mine = got[0] == i
            assert got[1][mine].tolist() == [c for c, _ in best]
            assert np.allclose(got[2][mine], [s for _, s in best])
            if best:
                assert np.isclose(got[3][i], lo) and np.isclose(got[4][i], hi)
        assert 1 not in got[0]


def test_large_norms_first_leave_most_cells_out():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 8)) / (1 + np.arange(20_000))[:, None]
    *_, cells = scoring.ItemBlock(v, np.zeros(len(v))).best_unseen(rng.normal(size=(50, 8)), np.zeros(50), np.zeros(0, np.int64), np.zeros(0, np.int64), 5)
    assert cells < 0.05 * 50 * len(v)


@pytest.mark.parametrize("biases", [False, True])
def test_single_precision_only_screens(biases, monkeypatch):
    """Scores closer than single precision tells apart keep their order, and almost all cells are multiplied in it."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(9000, 6))
    v[3000:] = v[0] * (1 + 1e-8 * rng.integers(0, 40, size=(6000, 1)))      # many within an error of the best and the lowest
    u = np.concatenate((v[:4] * 10, -v[:4], rng.normal(size=(12, 6))))
    bi = 1e-8 * rng.normal(size=len(v)) if biases else np.zeros(len(v))
    bu = rng.normal(size=len(u)) if biases else np.zeros(len(u))
    seen = {(int(r), int(c)) for r, c in zip(rng.integers(0, len(u), 300), rng.integers(0, len(v), 300))}
    rough, screen = [], scoring.ItemBlock._screen
    monkeypatch.setattr(scoring.ItemBlock, "_screen", lambda self, *a: rough.append(len(a[4]) * (a[-1] - a[-2])) or screen(self, *a))
    row, pos = np.array(sorted(seen)).T
    got = scoring.ItemBlock(v, bi).best_unseen(u, bu, row, pos, 4)
    for i, (best, lo, hi) in enumerate(by_hand(u, bu, v, bi, seen, 4)):
        assert got[1][got[0] == i].tolist() == [c for c, _ in best]
        assert abs(got[3][i] - lo) < 1e-12 * 100 and abs(got[4][i] - hi) < 1e-12 * 100
    assert sum(rough) > 0.8 * got[5]
    big = scoring.ItemBlock(v * 1e30, bi).best_unseen(u, bu, row, pos, 4)     # beyond single precision: all in double
    assert len(big[0]) == len(got[0]) and np.isfinite(big[3]).all()


def test_streamed_equals_block_pairs_for_text_ids(spark):
    rng = np.random.default_rng(7)
    users = spark.createDataFrame([(f"u{i}", [float(x) for x in rng.normal(size=3)], float(i)) for i in range(30)] + [("none", [0.0, 0.0, 0.0], 0.0)],
                                  "userId string, features array<double>, bias double")
    items = spark.createDataFrame([(f"ü{i}", [float(x) for x in rng.normal(size=3) * (1 + i % 9)], float(i % 3)) for i in range(70)],
                                  "itemId string, features array<double>, bias double")
    pairs = [(f"u{rng.integers(30)}", f"ü{rng.integers(90)}") for _ in range(300)] + [("u3", f"ü{i}") for i in range(70)] + [("u4", None), ("gone", "ü1")]
    seen = spark.createDataFrame([*pairs, pairs[0]], "userId string, itemId string")
    a = sorted(map(tuple, factors.factor_recommend(users, items, seen, n=4).collect()))
    b = sorted(map(tuple, factors.factor_recommend(users, items, seen, n=4, max_slice_bytes=600).collect()))
    assert a == b and len(a) == 30 * 4 and not any(r[0] == "u3" for r in a)
    for u, i in ((users.limit(0), items), (users, items.limit(0))):
        assert factors.factor_recommend(u, i, seen, n=4).count() == 0
