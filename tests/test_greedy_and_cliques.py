"""Greedy folds and largest cliques next to plain searches."""

import random
from itertools import combinations

from rankloom.operators import consensus, contents


def plain_deal(sizes, loads):
    out = []
    for size, groups in sizes:
        for at in range(groups):
            fold = min(range(len(loads)), key=lambda i: loads[i])
            loads[fold] += size
            out.append((size, at, fold))
    return out


def test_dealt_runs_equal_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [(s, rng.randrange(1, 40)) for s in sorted(rng.sample(range(1, 60), rng.randrange(1, 8)), reverse=True)]
        start = [rng.choice((0, 0, 5, 30, 200)) for _ in range(rng.randrange(2, 7))]
        fast, slow = list(start), list(start)
        lines = contents.dealt_runs(sizes, fast)
        dealt = sorted((size, at, ring[(at - first) % len(ring)]) for size, first, last, ring in lines for at in range(first, last + 1))
        assert dealt == sorted(plain_deal(sizes, slow)) and fast == slow
        assert len(lines) <= 2 * len(sizes) * len(start)
    assert len(contents.dealt_runs([(10**9, 1), (1, 10**12)], [0] * 5)) < 12


def test_greedy_folds(spark):
    rows = [(f"g{i}", 1 if i % 3 else -1) for i in range(60) for _ in range(i % 7 + 1)] + [("hot", 1)] * 120
    frame = spark.createDataFrame(rows, "content_group string, sign int")
    found = contents.greedy_folds(frame, "content_group", 4, 5, "sign").collect()
    assert len(found) == 61 and len({r.content_group for r in found}) == 61
    loads, by_place = [0] * 4, {}
    for sign in (-1, 1):
        group = sorted((r for r in found if r.sign == sign), key=lambda r: (-r.size, __import__("hashlib").sha256(f"5|{r.content_group}".encode()).hexdigest()))
        for r in group:
            by_place[r.content_group] = min(range(4), key=lambda i: loads[i])
            loads[by_place[r.content_group]] += r.size
    assert {r.content_group: r.fold for r in found} == by_place


def test_largest_cliques(spark):
    rng = random.Random(8)
    edges, wanted = [], {}
    for g in range(12):
        n = rng.randrange(2, 15)
        gap = {(a, b): rng.randrange(1, 9) / 4 for a, b in combinations(range(1, n + 1), 2) if rng.random() < rng.choice((0.3, 0.6, 0.95))}
        edges += [(g, a, b, d) for (a, b), d in gap.items()]
        for size in range(n, 1, -1):
            best = {c: sum(gap[p] for p in combinations(c, 2)) for c in combinations(range(1, n + 1), size) if all(p in gap for p in combinations(c, 2))}
            if best:
                wanted[g] = best
                break
    edges += [(99, a, b, 1.0) for a, b in combinations(range(1, 15), 2)]  # fourteen runs that all agree
    wanted[99] = {tuple(range(1, 15)): 91.0}
    found = {}
    for r in consensus.largest_cliques(spark.createDataFrame(edges, "g int, a int, b int, gap_mm double"), ["g"]).collect():
        found.setdefault(r.g, {})[tuple(r.members)] = r.total
    assert found == wanted
