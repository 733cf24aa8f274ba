"""Negatives of users whose hash draws fall short."""

from collections import defaultdict

import pytest

from rankloom.operators import samples


def items(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["user_id"]].append(r["item_id"])
    return out


# run: items listed at once; small ones make many runs of one user
@pytest.mark.parametrize(("n_items", "run"), [(20, 4096), (2000, 64)])
def test_users_with_few_unvisited_items_keep_their_lists(spark, monkeypatch, n_items, run):
    monkeypatch.setattr(samples, "RUN", run)
    pools = {u: {(u * 7 + i * 3) % n_items for i in range(size)} for u, size in enumerate([8, 9, 9, 9, 10, 12, 0] * 3)}
    visits = spark.createDataFrame([(u, i, f"2020-01-{1 + i % 28:02}") for u, pool in pools.items() for i in range(n_items) if i not in pool], "user_id long, item_id long, date string")
    got = items(samples.negatives(visits.select("user_id").distinct(), visits, n_items).collect())
    for u, pool in pools.items():
        assert len(got[u]) == len(set(got[u])) == min(9, len(pool))
        assert set(got[u]) <= pool
    lists = items(samples.candidate_lists(visits, ["item_id"], n_items).collect())
    assert set(lists) == {u for u, pool in pools.items() if len(pool) >= 9}
    assert all(len(set(x)) == 10 for x in lists.values())


def test_draws_come_before_the_rest(spark):
    visits = spark.createDataFrame([(u, i) for u in range(40) for i in range(200) if i % 10 != u % 10], "user_id long, item_id long")
    users = visits.select("user_id").distinct()
    drawn = items(users.select("user_id", samples.F.explode(samples.F.sequence(samples.F.lit(0), samples.F.lit(63))).alias("j")).select("user_id", samples.draw(200, samples.F.lit("n"), "user_id", "j").alias("item_id")).collect())
    got = items(samples.negatives(users, visits, 200).collect())
    for u in range(40):
        found = {i for i in drawn[u] if i % 10 == u % 10}
        assert len(got[u]) == 9
        assert found <= set(got[u]) or len(found) > 9


def test_draws_are_never_rows_of_a_shuffle(spark):
    """Users' draws meet the visits as one array a user, and the lists need no window: what shuffles are visits and short rows."""
    visits = spark.range(4000).selectExpr("id % 100 user_id", "id * 7 % 500 item_id", "concat('2020-01-', 10 + id % 20) date", "id line")
    lists = samples.candidate_lists(visits, ["line"], 500)
    lists.collect()
    plan = lists._jdf.queryExecution().optimizedPlan()
    assert "AS j#" not in plan.toString()
    assert plan.toString().count("Window [") <= 1  # the rest of those whose draws fall short
    visited = {(r["user_id"], r["item_id"]) for r in visits.collect()}
    rows = lists.collect()
    assert {(r["user_id"], r["item_id"]) for r in rows if not r["is_positive"]}.isdisjoint(visited)
    assert {r["user_id"] for r in rows} == set(range(100)) and len(rows) == 1000


def test_one_user_with_very_many_visits(spark):
    visits = spark.range(60_000).selectExpr("CASE WHEN id < 50000 THEN 0 ELSE id % 50 END user_id", "id % 3000 item_id", "'2020-01-01' date", "id line")
    got = items(samples.negatives(visits.select("user_id").distinct(), visits, 3005).collect())
    assert sorted(got[0]) == [3000, 3001, 3002, 3003, 3004]
    assert all(len(set(got[u])) == 9 for u in range(1, 50))


def test_users_are_capped_in_one_pass(spark):
    visits = spark.range(4000).selectExpr("id % 100 user_id", "id * 7 % 500 item_id", "concat('2020-01-', 10 + id % 20) date", "id line")
    lists = samples.candidate_lists(visits, ["line"], 500)
    capped = samples.capped_users(lists, 7, samples.CANDIDATES)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(capped) == rows(samples.capped_users(lists, 7)) and len(rows(capped)) == 70
    assert capped._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
