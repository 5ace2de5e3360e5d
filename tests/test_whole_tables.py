"""Whole-table queries against brute force over a small fixture."""

from itertools import combinations
from math import asin, degrees, hypot

from pyspark.sql import functions as F

from pipeweave.operators import admissible
from pipeweave.plans import catalog, rules

CLEARANCE = {r[0]: r for r in rules.RULE_ROWS}


class Brute:
    """The scene's rows in Python, by the formulas of its views."""

    def __init__(self, customers, parts):
        at = {c: ((c * 7919) % 20000 / 10, (c * 104729) % 60000 / 10) for c in customers}
        self.links = {c: (*at[c], *at[(c - 1) // 2]) for c in customers if (c - 1) // 2 in at}
        names = {0: "oks", 1: "park", 2: "social_area", 3: "prohibited_site", 4: "water", 5: "railway", 6: "road", 7: "tram_tracks", 8: "gas_pipeline", 9: "power_cable", 10: "heat_network", 11: "unlisted"}
        self.boxes = [(names[p % 12], (p * 3571) % 2000, (p * 9973) % 6000, (p * 3571) % 2000 + size, (p * 9973) % 6000 + size) for p, size in parts]
        line = lambda c: [((c * 7919 + k * k * 1313 + k * 37) % 2000 / 10, (c * 104729 + k * 977) % 6000 / 10) for k in range(6)]
        self.edges = {c * 10 + k: (*v[k - 1], *v[k]) for c in customers for v in [line(c)] for k in range(1, 6)}


def clip(seg, box):
    """Share of the segment inside the closed box, by its half planes, or None; and the lower share of either axis."""
    ax, ay, bx, by = seg
    lo, hi, enters = 0.0, 1.0, []
    for a, d, low, high in ((ax, bx - ax, box[0], box[2]), (ay, by - ay, box[1], box[3])):
        if d == 0:
            if not low <= a <= high:
                return None
            enters.append(float("-inf"))
            continue
        s, t = sorted(((low - a) / d, (high - a) / d))
        enters.append(s)
        lo, hi = max(lo, s), min(hi, t)
    return (lo, hi, enters) if lo <= hi else None


def verdict(seg, boxes):
    """What ``admissible.check`` says of a segment, each object looked at in turn; None without an object near."""
    ax, ay, bx, by = seg
    n, out = hypot(bx - ax, by - ay), [0, 0, 0, 0, 100]
    near = False
    for kind, *b in boxes:
        if kind not in CLEARANCE or min(ax, bx) - 12 > b[2] or max(ax, bx) + 12 < b[0] or min(ay, by) - 12 > b[3] or max(ay, by) + 12 < b[1]:
            continue
        near = True
        _, sort, clearance, angle, extent, kspec, width = CLEARANCE[kind]
        inside = clip(seg, b)
        if inside is None:
            point = lambda x, y: hypot(max(b[0] - x, x - b[2], 0), max(b[1] - y, y - b[3], 0))

            def to_segment(x, y):
                t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (n * n))) if n else 0
                return hypot(ax + (bx - ax) * t - x, ay + (by - ay) * t - y)

            d = min(point(ax, ay), point(bx, by), *(to_segment(x, y) for x in (b[0], b[2]) for y in (b[1], b[3])))
            out[1] += d < clearance / 1000 + 0.255 + width / 2000 - 0.001
        elif sort == "FORBIDDEN":
            out[0] += 1
        else:
            lo, hi, (ex, ey) = inside
            at = degrees(asin(min(1, (abs(bx - ax) if ex >= ey else abs(by - ay)) / n))) if n else 90
            out[2] += at < angle
            out[3] += not (lo * n - extent >= 0 and hi * n + extent <= n)
            out[4] = max(out[4], kspec)
    return tuple(out) if near else None


def fixture(spark, folder):
    customers, parts = range(1, 61), [(p, p % 50 + 1) for p in range(1, 241)]
    spark.createDataFrame([(c, 100.0 * c) for c in customers], "c_custkey bigint, c_acctbal double").write.parquet(str(folder / "customer.parquet"))
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(str(folder / "part.parquet"))
    return Brute(customers, parts)


def test_all_links_and_lines(spark, tmp_path):
    brute = fixture(spark, tmp_path)
    ask = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()

    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    cross = lambda s, t: side(s, t[0], t[1]) * side(s, t[2], t[3]) < 0 and side(t, s[0], s[1]) * side(t, s[2], s[3]) < 0
    pairs = sorted((a, b) for a, b in combinations(sorted(brute.edges), 2) if cross(brute.edges[a], brute.edges[b]))
    assert sorted((r.a, r.b) for r in ask("j17_segment_crossings")) == pairs
    assert any(a // 10 % 15 or b // 10 % 15 for a, b in pairs)

    wet = {c: sum(k == "water" and clip(seg, b) is not None for k, *b in brute.boxes) for c, seg in brute.links.items()}
    assert {r.child: r.n for r in ask("p08_blocked_segments")} == {c: n for c, n in wet.items() if n}

    verdicts = {c: v for c, seg in brute.links.items() if (v := verdict(seg, brute.boxes))}
    assert {r.child: tuple(r)[1:] for r in ask("p05_segment_check")} == verdicts
    assert len({c % 25 for c in verdicts}) > 1

    meets = lambda s, b: min(s[0], s[2]) - 15 <= b[2] and max(s[0], s[2]) + 15 >= b[0] and min(s[1], s[3]) - 15 <= b[3] and max(s[1], s[3]) + 15 >= b[1]
    gas = {c: sum(k == "gas_pipeline" and meets(seg, b) for k, *b in brute.boxes) for c, seg in brute.links.items()}
    assert {r.child: r.objects for r in ask("j18_chain_objects")} == {c: n for c, n in gas.items() if n}


def test_check_of_segments_along_the_axes(spark):
    """Starting inside an object, passing it, clear of it, along its edge, and without a length."""
    boxes = [("road", 10.0, 10.0, 20.0, 20.0), ("gas_pipeline", 40.0, 0.0, 44.0, 60.0), ("park", 60.0, 10.0, 70.0, 12.0)]
    segments = [(15.0, 15.0, 15.0, 40.0), (15.0, 0.0, 15.0, 40.0), (0.0, 15.0, 55.0, 15.0), (21.0, 0.0, 21.0, 40.0), (15.0, 15.0, 15.0, 15.0), (42.0, 5.0, 42.0, 50.0), (50.0, 11.0, 90.0, 11.0), (0.0, 20.0, 30.0, 20.0), (5.0, 5.0, 5.0, 5.0)]
    lines = spark.createDataFrame([(i, *s) for i, s in enumerate(segments)], "child bigint, ax double, ay double, bx double, by_ double")
    ruled = spark.createDataFrame(boxes, "restriction_type string, xmin double, ymin double, xmax double, ymax double").join(F.broadcast(rules.table(spark, "rules")), "restriction_type")
    got = {r.child: tuple(r)[1:] for r in admissible.check(lines, ruled, "child", 0.255).collect()}
    assert got == {i: v for i, s in enumerate(segments) if (v := verdict(s, boxes))}
