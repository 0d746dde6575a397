"""User pairs by lists and by block products give the rows of plain Python, and no pair is shuffled."""

import math
from collections import defaultdict

import pytest

from rivulet.operators import sets
from rivulet.operators import similarity as sim


def _rows(n_users=40, n_items=12, text=False):
    out = {(u, (u * u + j * j * 3 + u * j) % n_items + 5) for u in range(1, n_users) for j in range(u % 7 + 1)}
    return [(f"u{u}", f"i{i}") if text else (u - 20, i) for u, i in sorted(out)]


def _expected(rows, k=None):
    mine, audience = defaultdict(set), defaultdict(set)
    for u, i in rows:
        mine[u].add(i)
        audience[i].add(u)
    weight = {i: math.floor(1 / math.log(1 + len(a)) * sim.WEIGHT_UNITS + 0.5) for i, a in audience.items()}
    out = {}
    for u in mine:
        found = [(sum(weight[i] for i in mine[u] & mine[v]), v) for v in mine if v != u]
        found = sorted((-co / math.sqrt(len(mine[v])), v) for co, v in found if co)
        out[u] = [v for _, v in found[:k]]
    return out


@pytest.mark.parametrize("text,cells,hot,bucket", [(False, 0, None, 3), (True, 0, None, 1024), (True, 10 ** 9, None, 3), (False, 0, 12, 3),
                                                   (True, 10 ** 9, 12, 1024), (False, 10 ** 9, 0, 1024)])
def test_nearest_users(spark, monkeypatch, text, cells, hot, bucket):
    monkeypatch.setattr(sim, "GRID_CELLS", cells)
    monkeypatch.setattr(sets, "CHUNK_CELLS", 100)
    monkeypatch.setattr(sets, "BLOCK_SETS", 16)
    rows = _rows(text=text)
    got = defaultdict(list)
    inter = spark.createDataFrame(rows, ["userId", "itemId"])
    for r in sim.nearest_users(inter, 4, "iif", bucket, hot_threshold=hot).orderBy("userId", "rank").collect():
        got[r["userId"]].append(r["otherId"])
    assert dict(got) == {u: vs for u, vs in _expected(rows, 4).items() if vs}


@pytest.mark.parametrize("cells", [0, 10 ** 9])
@pytest.mark.parametrize("bucket", [3, 1024])
def test_all_pairs(spark, monkeypatch, cells, bucket):
    monkeypatch.setattr(sim, "GRID_CELLS", cells)
    rows = _rows()
    inter = spark.createDataFrame(rows + [(None, 7), (3, None), rows[0]], ["userId", "itemId"])
    both = [(r["userId"], r["otherId"]) for r in sim.user_similarity(inter, "iif", bucket).collect()]
    assert len(both) == len(set(both))
    assert set(both) == {(u, v) for u, vs in _expected(rows).items() for v in vs}
    pairs = sim.pair_cocounts(inter, "cosine", bucket).collect()
    mine = defaultdict(set)
    for u, i in rows:
        mine[u].add(i)
    assert sorted((r["u"], r["v"], r["nu"], r["nv"], r["co"]) for r in pairs) == sorted(
        (u, v, len(mine[u]), len(mine[v]), float(len(mine[u] & mine[v]))) for u in mine for v in mine if u < v and mine[u] & mine[v])


def test_sums_beyond_doubles(spark):
    left = spark.createDataFrame([(1, 2, ["a", "b"], [2 ** 60 + 1, 1]), (2, 1, ["b"], [5])], "userId long, n long, items array<string>, ws array<long>")
    right = spark.createDataFrame([(9, 4, ["a", "b", "c"]), (2, 1, ["b"])], "otherId long, m long, items array<string>")
    got = sets.match_sets(left, right, "userId", 1, same=True).collect()
    assert (1, 9, 2 ** 60 + 2, 2, 4) in [tuple(r) for r in got]


@pytest.mark.parametrize("cells", [0, 10 ** 9])
def test_pairs_are_not_shuffled(spark, monkeypatch, cells):
    """The sums of a pair are made where its lists meet: no exchange is dealt by two users."""
    monkeypatch.setattr(sim, "GRID_CELLS", cells)
    inter = spark.createDataFrame(_rows(), ["userId", "itemId"])
    for df in (sim.user_similarity(inter, "cosine"), sim.pair_cocounts(inter), sim.nearest_users(inter, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange hashpartitioning(" in line:
                assert not ("u#" in line and "v#" in line) and "otherId#" not in line.split("hashpartitioning(")[1].split("),")[0], line


def test_usercf_of_long_lists(spark, monkeypatch):
    rows = _rows()
    inter = spark.createDataFrame(rows, ["userId", "itemId"])
    want = sorted(map(tuple, sim.usercf_recommend(inter, 3, 4).collect()))
    monkeypatch.setattr(sim, "LIST_ITEMS", 2)
    assert sorted(map(tuple, sim.usercf_recommend(inter, 3, 4).collect())) == want
    near, mine = defaultdict(dict), defaultdict(set)
    for u, i in rows:
        mine[u].add(i)
    for r in sim.nearest_users(inter, 4).collect():
        near[r["userId"]][r["otherId"]] = math.floor(r["sim"] * sim.SCORE_UNITS + 0.5)
    for u in mine:
        score = defaultdict(int)
        for v, s in near[u].items():
            for i in mine[v] - mine[u]:
                score[i] += s
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r[1], r[3]) for r in want if r[0] == u and r[3] <= 3] == sorted([(i, n + 1) for n, (i, _) in enumerate(best)])


def test_similarities_are_made_once_a_pair(spark, monkeypatch):
    """Both directions come from one: the lists that are dealt hold each pair of an item once."""
    monkeypatch.setattr(sim, "GRID_CELLS", 0)
    asked, listed = [], sim._listed
    monkeypatch.setattr(sim, "_listed", lambda *a, both, **k: asked.append(both) or listed(*a, both=both, **k))
    got = {(r["userId"], r["otherId"]): r["sim"] for r in sim.user_similarity(spark.createDataFrame(_rows(), ["userId", "itemId"])).collect()}
    assert asked == [False]
    assert set(got) == {(u, v) for u, vs in _expected(_rows()).items() for v in vs} and all(got[v, u] == s for (u, v), s in got.items())
