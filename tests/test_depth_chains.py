"""Whole chains of the depth query against a brute-force search over depths."""

from collections import defaultdict

from pipeweave.operators import depth
from pipeweave.plans import catalog, rules

PRICE, LENGTH = 83530.0, 500.0
KINDS = ("road", "tram_tracks", "gas_pipeline", "power_cable")
#: Orders with their places (partkey) of lines 1, 2, ...: apart, near each other, touching, before and after the third.
ORDERS = {1: [1, 9, 17, 25, 30], 2: [2, 4, 6, 8, 10, 12, 14], 3: [1, 2, 3, 4], 4: [3, 10, 11, 29], 5: [30, 20, 10, 5, 1], 6: [5, 6, 20, 28], 7: [2, 9, 3, 28], 10: [1, 3, 5, 7, 9, 11, 13], 11: [4, 13]}


def options(kind):
    """Admissible depths at one crossing, in mm, by the vertical rules."""
    _, method, cover, top, height, gap = next(r for r in rules.VERTICAL_ROWS if r[0] == kind)
    if method == "COVER":
        return [(max(700, cover), 100_000)]
    return [(lo, hi) for lo, hi in ((700, top - gap - 160), (max(700, top + height + gap), 100_000)) if lo <= hi]


def cheapest(order, places):
    """Least extra cost over all depths on a lattice of 20 mm at every section, sections taken one by one; None if none fits."""
    allowed = options(KINDS[order % 4])
    levels = []
    for lo in sorted(20.0 + (p * 13) % 400 for p in places):
        if levels and lo <= levels[-1][1]:
            levels[-1][1] = lo + 4
        else:
            levels.append([lo, lo + 4])
    depths = [h for h in range(700, 5001, 20) if any(a <= h <= b for a, b in allowed)]
    dear = lambda h: max(0.0, h / 1000 - 3) * 0.1 * PRICE

    def ramp(h, g):
        """Cost and length of the ramp between two depths."""
        over, under = max(h, g), min(h, g)
        steep = (over - max(under, 3000)) / 1000 / 0.1 if over > 3000 else 0.0
        return steep * (dear(over) + dear(max(under, 3000))) / 2, (over - under) / 1000 / 0.1

    def between(gap, h, g):
        (down, n), (up, m) = ramp(h, 3000), ramp(3000, g)
        if n + m + 5 <= gap:
            return down + up
        n = ramp(h, g)[1]
        if n > gap + 1e-6:
            return None
        # One even ramp over the whole gap.
        if min(h, g) >= 3000 or max(h, g) <= 3000:
            return gap * (dear(h) + dear(g)) / 2
        return gap * (max(h, g) - 3000) / (max(h, g) - min(h, g)) * dear(max(h, g)) / 2

    best, at = {3000: 0.0}, 0.0
    for lo, hi in levels:
        after = {}
        for g in depths:
            costs = [c + b for h, c in best.items() if (b := between(lo - at, h, g)) is not None]
            if costs:
                after[g] = min(costs) + (hi - lo) * dear(g)
        best, at = after, hi
    ends = [c + b for h, c in best.items() if (b := between(LENGTH - at, h, 3000)) is not None]
    return min(ends) if ends else None


def test_profiles_of_whole_chains(spark, tmp_path):
    lines = [(o, i + 1, p, 1.0) for o, places in ORDERS.items() for i, p in enumerate(places)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = defaultdict(list)
    for r in catalog.QUERIES["o13_depth_profiles"](spark, str(tmp_path)).orderBy("chain", "seq").collect():
        found[r.chain].append(r)
    assert set(found) == set(ORDERS)
    for order, rows in found.items():
        cost = cheapest(order, ORDERS[order])
        assert rows[0].feasible == (cost is not None), order
        if cost is None:
            continue
        assert abs(rows[0].cost - cost) <= 1, (order, rows[0].cost, cost)
        for p in ORDERS[order]:
            lo, hi = (20 + (p * 13) % 400) * 1000, (24 + (p * 13) % 400) * 1000
            held = [level(rows, s) for s in (lo, (lo + hi) // 2, hi)]
            assert any(all(a - 1 <= h <= b + 1 for h in held) for a, b in options(KINDS[order % 4])), (order, p, held)


def level(rows, s):
    """Depth of the profile at a measure, in mm."""
    for a, b in zip(rows, rows[1:]):
        if a.s_mm <= s <= b.s_mm and b.s_mm > a.s_mm:
            return a.h_mm + (b.h_mm - a.h_mm) * (s - a.s_mm) / (b.s_mm - a.s_mm)
    return rows[-1].h_mm


def every_choice(length, crossings, prices, start, end):
    """The least key over all choices of options, each settled for itself."""
    from itertools import product

    levels, best = depth.plateaus(crossings), None
    for choice in product(*(p["options"] for p in levels)):
        reach, at, ok = [(0.7, 100.0) if start is None else (start, start)], 0.0, True
        for p, (a, b) in zip(levels, choice):
            room = 0.1 * (p["lo"] - at) + 1e-9
            reach.append((max(a, reach[-1][0] - room), min(b, reach[-1][1] + room)))
            ok, at = ok and reach[-1][0] <= reach[-1][1], p["hi"]
        room = 0.1 * (length - at) + 1e-9
        last = (max(0.7, reach[-1][0] - room), min(100.0, reach[-1][1] + room))
        if not ok or end is not None and not last[0] <= end <= last[1]:
            continue
        near = lambda lo, hi: min(max(3.0, lo), hi)
        final = end if end is not None else near(*last)
        h, at, held = final, length, []
        for p, (lo, hi) in zip(levels[::-1], reach[:0:-1]):
            c, d = max(lo, h - 0.1 * (at - p["hi"]) - 3e-9), min(hi, h + 0.1 * (at - p["hi"]) + 3e-9)
            ok = ok and c <= d
            h, at = near(c, d), p["lo"]
            held.insert(0, h)
        if not ok:
            continue
        begin = start if start is not None else 3.0 if not levels and end is None else near(max(0.7, h - 0.1 * at), min(100.0, h + 0.1 * at))
        points = [(0.0, begin)]
        for p, h in zip(levels, held):
            ok = ok and depth.connect(points, *points[-1], p["lo"], h)
            points.append((p["hi"], h))
        if ok and depth.connect(points, *points[-1], length, final):
            cost, off, moves = depth.profile_key(points, prices)
            key = (round(cost, 6), round(off, 6), moves)
            best = min(best or key, key)
    return best


def test_search_is_the_best_of_all_choices():
    import random

    r = random.Random(31)
    seen = set()
    for _ in range(300):
        length = r.uniform(60, 400)
        found = []
        for _ in range(r.randrange(0, 7)):
            lo = r.uniform(1, length - 8)
            a, b = r.uniform(0.7, 2.5), r.uniform(3.1, 6)
            found.append({"lo": lo, "hi": lo + r.uniform(1, 6), "options": r.choice([[(0.7, a), (b, 100.0)], [(b, 100.0)], [(1.0, 100.0)], [(0.7, a), (a + 0.2, a + 0.4), (b, 100.0)]])})
        start, end = r.choice([None, 3.0]), r.choice([None, 3.0, 2.5, 4.0])
        prices = [(length * 0.4, 100.0), (length, 300.0)]
        want, got = every_choice(length, found, prices, start, end), depth.search(length, found, prices, start, end)
        seen.add(want is None)
        assert (want is None) == (got is None)
        if want is not None:
            cost, off, moves = depth.profile_key(got[0], prices)
            assert abs(cost - got[1]) < 1e-6 and abs(cost - want[0]) < 1e-5 and (abs(off - want[1]) < 1e-4 or cost < want[0] - 1e-9), (want, cost, off, moves)
            assert all(abs(h - g) <= 0.1 * (b - a) + 1e-6 for (a, h), (b, g) in zip(got[0], got[0][1:]))
    assert seen == {True, False}


def test_forty_crossings_have_no_limit():
    """2^40 choices."""
    found = [{"lo": 10.0 + 60 * i, "hi": 14.0 + 60 * i, "options": [(0.7, 2.0), (3.4, 100.0)]} for i in range(40)]
    points, cost = depth.optimise(2500.0, found, 100.0)
    assert cost == 0.0 and all(any(abs(s - c["lo"]) < 1e-6 and h <= 2.0 for s, h in points) for c in found)


def test_networks(spark):
    """Trees of up to six chains: depths meet at junctions, every chain is the best for the depth it joins at."""
    import random

    r = random.Random(5)
    links, crossings, scenes = [], [], 6
    for n in range(scenes):
        for i in range(1, 9):
            parent = r.randrange(0, i)
            links.append((100 * n + i, 100 * n + parent, bool(i % 2), round(r.uniform(40, 120), 1), float(r.choice([100, 200]))))
            if r.random() < 0.7:
                kind = r.choice(["COVER", "GAP"])
                lo = round(r.uniform(2, 30), 1)
                crossings.append((100 * n + i, lo, lo + 4, kind, 0.16, 2.8, 0.4, 0.2, 1.2))
    crossings.append((1, 5.0, 9.0, "COVER", 0.16, 2.8, 0.4, 0.2, 90.0))
    taken, rows = set(), []
    for child, parent, goes_on, length, price in links:
        goes_on = goes_on and parent % 100 > 0 and parent not in taken
        taken |= {parent} if goes_on else set()
        rows.append((child, parent, goes_on, length, price))
    df = spark.createDataFrame(rows, "child bigint, parent bigint, continues boolean, length_m double, price double")
    chained = depth.chained(df).cache()
    out = {x.child: x for x in depth.plan_network(chained, spark.createDataFrame(crossings, "child bigint, lo double, hi double, kind string, new_height double, top double, height double, gap double, cover double")).collect()}
    assert len(out) == len(rows)
    of, chains = {x.child: (x.chain, x.ord) for x in chained.collect()}, {}
    for child, parent, goes_on, length, price in rows:
        assert of[child][0] == (of[parent][0] if goes_on else child)
        chains.setdefault(of[child][0], []).append((of[child][1], child, parent, length, price))
    planned = 0
    for chain, parts in chains.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        top = parts[-1][2]
        end = 3.0 if top % 100 == 0 else None if out[top].start_mm is None else out[top].start_mm
        if end is None:
            assert not any(out[p[1]].feasible for p in parts)
            continue
        offs, at = {}, 0.0
        for _, child, _, length, _ in parts:
            offs[child], at = at, at + length
        found = [{"lo": offs[c[0]] + c[1], "hi": offs[c[0]] + c[2], "options": depth.options(*c[3:])} for c in crossings if c[0] in offs]
        prices = [(offs[p[1]] + p[3], p[4]) for p in parts]
        want = depth.search(at, found, prices, None, end if end == 3.0 else end / 1000)
        assert out[parts[-1][1]].feasible == (want is not None)
        if want:
            planned += 1
            assert abs(out[parts[-1][1]].cost - want[1]) <= 2 and out[parts[-1][1]].end_mm == (3000 if end == 3.0 else end)
            for a, b in zip(parts, parts[1:]):
                assert out[a[1]].end_mm == out[b[1]].start_mm
    assert planned > 10 and any(not x.feasible for x in out.values())


def test_chains_of_no_length_have_the_depth_they_join(spark):
    """A link between two consumers at one place: its chain's profile is a single point."""
    links = spark.createDataFrame([(1, 0, 1, 0, 100.0, 10.0), (2, 1, 2, 0, 0.0, 10.0), (3, 2, 3, 0, 50.0, 10.0)], "child bigint, parent bigint, chain bigint, ord int, length_m double, price double")
    crossings = spark.createDataFrame([(1, 0.0, 4.0, "COVER", 0.16, None, None, None, 5.0)], "child bigint, lo double, hi double, kind string, new_height double, top double, height double, gap double, cover double")
    out = {x.child: (x.start_mm, x.end_mm, x.cost, x.feasible) for x in depth.plan_network(links, crossings).collect()}
    assert out[1][:2] == (5000, 3000) and out[2] == (5000, 5000, 0, True) and out[3][1] == 5000 and out[3][3]


def test_like_chains_are_searched_once(spark, monkeypatch):
    """Chains with the same crossings, in whatever order, are one class; each still gets its own rows."""
    from pipeweave.operators import copies

    seen, fold = [], copies.folded
    monkeypatch.setattr(copies, "folded", lambda *args: seen.append(fold(*args)) or seen[-1])
    road = [(20.0, 24.0, "COVER", 0.16, None, None, None, 4.0), (80.0, 84.0, "GAP", 0.16, 1.0, 0.5, 0.2, None)]
    rows = [(chain, 200.0, 10.0, *c) for chain, found in ((1, road), (2, road[::-1]), (3, road), (4, road[:1])) for c in found]
    out = depth.plan_chains(spark.createDataFrame(rows, "chain bigint, length_m double, price double, lo double, hi double, kind string, new_height double, top double, height double, gap double, cover double"))
    found = defaultdict(list)
    for r in sorted(out.collect()):
        found[r.chain].append(tuple(r)[1:])
    assert set(found) == {1, 2, 3, 4} and found[1] == found[2] == found[3] != found[4]
    assert seen[0][0].count() == 2
