"""Rows that a block of near copies makes."""

import numpy as np
import pytest

from rankloom.llm import similar


def block(n, size, changed):
    draw = np.random.default_rng(5)
    base = draw.integers(1 << 62, size=size, dtype=np.uint64)
    sets = []
    for _ in range(n):
        s = base.copy()
        s[draw.choice(size, changed, replace=False)] = draw.integers(1 << 62, size=changed, dtype=np.uint64)
        sets.append(np.unique(s))
    fps = np.array([similar.print_of(s) for s in sets], np.int64).view(np.uint64)
    return sets, np.arange(n) * 3 + 7, fps, np.array([len(s) for s in sets]), [similar.sketch_of(s) for s in sets]


@pytest.mark.parametrize("n", [60, 300])
@pytest.mark.parametrize("most", [similar.FIRST, similar.FIRST * similar.GROWTH**2])
def test_sure_links_of_a_block_are_fewer_than_its_members(n, most):
    _, ids, fps, sizes, sketches = block(n, 100, 1)
    u, v, sure, _ = similar.partners(ids, fps, ids, sizes, sketches, most)
    assert len(u) < n and sure.all()
    if most > n:
        assert len(u) == n - 1 and set(u) | set(v) == set(ids)


def test_stars_and_tried_pairs_reach_what_all_pairs_reach():
    sets, ids, fps, sizes, sketches = block(80, 150, 9)
    u, v, sure, more = similar.partners(ids, fps, ids, sizes, sketches, 1000)
    assert not more
    place = {d: i for i, d in enumerate(ids.tolist())}
    alike = lambda a, b: len(np.intersect1d(a, b)) >= similar.SIMILARITY * len(np.union1d(a, b))
    held = [(place[a], place[b]) for a, b, s in zip(u.tolist(), v.tolist(), sure.tolist(), strict=True) if s or alike(sets[place[a]], sets[place[b]])]
    near = [(i, j) for i in range(80) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= similar.WIDE and alike(sets[i], sets[j])]
    root = lambda pairs: similar.forest(*np.array(pairs, np.int64).reshape(-1, 2).T, 80).tolist()
    assert root(held) == root(near)
