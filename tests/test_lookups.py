"""Lookup edge rows (FIXTURES.md part C)."""

from rivulet.operators import lookup


def test_popularity_lookup_default_zero(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "itemId long")
    pop = spark.createDataFrame([(1, 1234567), (3, 5)], "itemId long, user_count long")
    got = {r.itemId: (r.user_count, r.user_count_text) for r in lookup.popularity_lookup(ids, pop).collect()}
    assert got == {1: (1234567, "1,234,567"), 2: (0, "0"), 3: (5, "5")}


def test_cards_flag_lists_not_of_ten(spark):
    users = spark.createDataFrame([(i, f"n{i}", "M", 20, 5, 1) for i in range(1, 13)],
                                  "userId long, name string, gender string, age int, fans long, following long")
    sim = spark.createDataFrame([(1, ";".join(str(i) for i in range(2, 12))), (2, "3;4"), (3, "")],
                                "userId long, similarUsers string")
    rows = lookup.similar_user_cards(sim, users).collect()
    by = {}
    for r in rows:
        by.setdefault(r.userId, []).append(r)
    assert len(by[1]) == 10 and all(r.valid for r in by[1]) and by[1][0].name is not None
    assert [r.similarId for r in sorted(by[2], key=lambda r: r.rank)] == [3, 4] and not by[2][0].valid
    assert 3 not in by                                         # empty list: no cards


def test_recommendation_cards_truncate_and_unknown(spark):
    items = spark.createDataFrame([(7, 60, 1, 2, 3, 4, "x" * 50)],
                                  "itemId long, length int, comment long, like long, watch long, share long, name string")
    recs = spark.createDataFrame([(1, "7; 8")], "userId long, itemId string")
    rows = sorted(lookup.recommendation_cards(recs, items).collect(), key=lambda r: r.rank)
    assert rows[0].title == "x" * 35 and rows[1].itemId == 8 and rows[1].title is None
    assert not rows[0].valid


def test_peers_of_single_member_cluster(spark):
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "userId long, cluster int")
    users = spark.createDataFrame([(1, "a", "M", 20, 1, 1), (2, "b", "F", 30, 2, 2), (3, "c", "F", 40, 3, 3)],
                                  "userId long, name string, gender string, age int, fans long, following long")
    got = {(r.userId, r.peerId, r.name) for r in lookup.user_peers(members, users).collect()}
    assert got == {(1, 2, "b"), (2, 1, "a")}
