import random

import numpy as np

from riskfold.llm import packing


def test_plan_places_each_piece_once_and_shrinks_bins():
    rnd = np.random.default_rng(1)
    for _ in range(80):
        sizes = sorted(rnd.choice([8, 16, 24, 32, 64], size=int(rnd.integers(1, 4)), replace=False).tolist())
        counts = {int(n): int(rnd.integers(1, 40)) for n in rnd.integers(1, max(sizes) + 1, size=12)}
        plan = packing.plan(counts, sizes)
        taken, seen = set(), set()
        for length, lo, hi, first, per, offset in plan.places:
            for r in range(lo, hi):
                seen.add((length, r))
                b, o = first + (r - lo) // per, offset + (r - lo) % per * length
                cells = {(b, x) for x in range(o, o + length)}
                assert not cells & taken
                taken |= cells
        assert len(seen) == sum(counts.values())
        used = np.bincount([b for b, _ in taken])
        for first, n, capacity, content in plan.bins:
            assert (used[first:first + n] == content).all() and capacity == min(s for s in sizes if s >= content)


def test_plan_equals_best_fit_one_by_one():
    """One capacity: as many bins as plain best fit decreasing opens."""
    rnd = random.Random(2)
    for _ in range(50):
        counts = {n: rnd.randint(1, 6) for n in rnd.sample(range(1, 33), 8)}
        rooms = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((r for r in rooms if r >= n), default=None)
                if fit is None:
                    rooms.append(32 - n)
                else:
                    rooms.remove(fit)
                    rooms.append(fit - n)
        plan = packing.plan(counts, [32])
        assert sum(n for _, n, _, _ in plan.bins) == len(rooms)


def test_edges(clashing, nothing):
    out = packing.pack(clashing, (16, 64, 256)).collect()
    per = {}
    for r in out:
        per.setdefault(r.bin_id, []).append(r)
        assert r.length >= 1 and r.offset + r.length <= r.capacity
    for rows in per.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert rows[0].capacity == min(c for c in (16, 64, 256) if c >= at)
    five = [r for r in out if r.doc_id == 5]
    assert sum(r.length for r in five) == 30_002 and sorted(r.start for r in five) == [256 * i for i in range(len(five))]
    assert sum(r.doc_id == 11 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    assert packing.pack(nothing).count() == 0
