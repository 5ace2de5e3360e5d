"""Vertical profiles: options at crossings and the cheapest profile of a chain.

A chain's crossings are gathered into one row (a chain is short) and a kernel takes chains by the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NORMAL, LEAST, SLOPE, REST, RATE, SANE = 3.0, 0.7, 0.10, 5.0, 0.10, 100.0
SCHEMA = "chain bigint, seq int, s_mm bigint, h_mm bigint, cost bigint, feasible boolean"


def plateaus(crossings: list[dict], touch: float = 1e-6) -> list[dict]:
    """Crossings (lo, hi, options) merged where their sections touch."""
    out: list[dict] = []
    for c in sorted(crossings, key=lambda c: (c["lo"], c["hi"])):
        if out and c["lo"] <= out[-1]["hi"] + touch:
            out[-1]["hi"] = max(out[-1]["hi"], c["hi"])
            out[-1]["parts"].append(c["options"])
        else:
            out.append({"lo": c["lo"], "hi": c["hi"], "parts": [c["options"]]})
    for p in out:
        merged = {(LEAST, SANE)}
        for options in p.pop("parts"):
            merged = {(max(a, c), min(b, d)) for a, b in merged for c, d in options if max(a, c) <= min(b, d)}
        p["options"] = sorted(merged)
    return out


def options(kind: str, new_height: float, top=None, height=None, gap=None, cover=None) -> list[tuple[float, float]]:
    """Admissible depths at one crossing: above or below a utility, or under a road."""
    if kind == "COVER":
        return [(max(LEAST, cover), SANE)]
    above, below = (LEAST, top - gap - new_height), (max(LEAST, top + height + gap), SANE)
    return [i for i in (above, below) if i[0] <= i[1]]


def k_depth(h: float) -> float:
    return 1 + RATE * max(0.0, h - NORMAL)


def connect(points: list, s0: float, h0: float, s1: float, h1: float) -> bool:
    """From one level to the next: back to the normal depth if both ramps and a rest fit, else one ramp."""
    gap = s1 - s0
    down, up = abs(h0 - NORMAL) / SLOPE, abs(h1 - NORMAL) / SLOPE
    if down + up + REST <= gap:
        points += [(s0 + down, NORMAL), (s1 - up, NORMAL), (s1, h1)]
        return True
    # Reached depths have a play of 1e-9 and are rounded to as much.
    if abs(h1 - h0) > SLOPE * gap + 1e-8:
        return False
    points.append((s1, h1))
    return True


def _cut(a: float, h: float, b: float, g: float, prices: list) -> list:
    """A ramp in pieces (length, h, g, price) over which neither the price nor the side of the normal depth changes."""
    marks = [a, b, *(to for to, _ in prices if a < to < b)]
    if (h - NORMAL) * (g - NORMAL) < 0:
        marks.append(a + (b - a) * (NORMAL - h) / (g - h))
    marks = sorted(marks)
    at = lambda s: h + (g - h) * (s - a) / (b - a) if b > a else g
    price = lambda s: next((p for to, p in prices if s <= to), prices[-1][1])
    return [(y - x, at(x), at(y), price((x + y) / 2)) for x, y in zip(marks, marks[1:]) if y > x]


def profile_key(points: list, prices: list) -> tuple[float, float, int]:
    """Extra cost, integral of the distance from the normal depth, and number of ramps of a profile; each adds up over its parts. ``prices``: (to, price a metre), in order."""
    cost = off = 0.0
    moves = 0
    for (a, h), (b, g) in zip(points, points[1:]):
        for n, u, v, price in _cut(a, h, b, g, prices):
            cost += n * price * ((k_depth(u) + k_depth(v)) / 2 - 1)
            off += n * (abs(u - NORMAL) + abs(v - NORMAL)) / 2
        moves += abs(h - g) > 1e-9
    return cost, off, moves


def extra_cost(points: list, price: float) -> float:
    """Integral of price * (K - 1): K is linear on either side of the normal depth."""
    return profile_key(points, [(float("inf"), price)])[0]


def _nearest(lo: float, hi: float) -> float:
    return min(max(NORMAL, lo), hi)


def search(length: float, crossings: list[dict], prices: list, start: float | None, end: float | None) -> tuple[list, float] | None:
    """Profile points (s, h) and their extra cost, the least by (cost, distance from the normal depth, ramps); ``start`` and ``end`` are depths or None where free.

    Every crossing has its options. Going forward, a choice at each gives the
    depths that can be reached there; choices that reach the same depths are one
    state from then on. Going backward, each state takes the depth nearest to
    the normal one that the next allows, and states of equal depths keep the
    cheapest rest. The states grow with the sum of the options, not with their
    product, so no number of crossings is too many.
    """
    levels = [p for p in plateaus([{"lo": max(0.0, c["lo"]), "hi": min(length, c["hi"]), "options": c["options"]} for c in crossings if min(length, c["hi"]) - max(0.0, c["lo"]) >= 1e-6])]
    if any(not p["options"] for p in levels):
        return None
    first = (LEAST, SANE) if start is None else (start, start)
    reach, at = [{first: set()}], 0.0
    for p in levels:
        room, now = SLOPE * (p["lo"] - at) + 1e-9, {}
        for lo, hi in reach[-1]:
            for a, b in p["options"]:
                c, d = max(a, lo - room), min(b, hi + room)
                if c <= d:
                    now.setdefault((round(c, 9), round(d, 9)), set()).add((lo, hi))
        if not now:
            return None
        reach.append(now)
        at = p["hi"]
    room = SLOPE * (length - at) + 1e-9
    # rest: (reached depths, depth here) -> (key, points from the beginning of this level on)
    rest: dict = {}
    for lo, hi in reach[-1]:
        c, d = max(LEAST, lo - room), min(SANE, hi + room)
        if end is not None and not c <= end <= d:
            continue
        depth = end if end is not None else _nearest(c, d)
        rest[(lo, hi), depth] = ((0.0, 0.0, 0), [(length, depth)])
    if levels:
        # Keys so far stand at the end of the chain; the first step back goes to the last level itself.
        states = {((lo, hi), None, depth): v for ((lo, hi), depth), v in rest.items()}
    else:
        states = {}
    for i in range(len(levels) - 1, -1, -1):
        p, now = levels[i], {}
        for ((lo, hi), _, depth), (key, points) in states.items():
            gap = points[0][0] - p["hi"]
            c, d = max(lo, depth - SLOPE * gap - 3e-9), min(hi, depth + SLOPE * gap + 3e-9)
            if c > d:
                continue
            h = _nearest(c, d)
            way = [(p["hi"], h)]
            if not connect(way, p["hi"], h, *points[0]):
                continue
            way = [(p["lo"], h), *way]
            k = tuple(x + y for x, y in zip(key, profile_key(way, prices), strict=True))
            for before in reach[i + 1][lo, hi]:
                found = now.get((before, h))
                if found is None or _rounded(k) < _rounded(found[0]):
                    now[before, h] = (k, [*way[:-1], *points])
        states = {(before, None, h): v for (before, h), v in now.items()}
    best = None
    for (_, _, depth), (key, points) in (states if levels else {(None, None, depth): v for (_, depth), v in rest.items()}).items():
        gap = points[0][0]
        begin = start if start is not None else NORMAL if not levels and end is None else _nearest(max(LEAST, depth - SLOPE * gap), min(SANE, depth + SLOPE * gap))
        way = [(0.0, begin)]
        if not connect(way, 0.0, begin, *points[0]):
            continue
        k = tuple(x + y for x, y in zip(key, profile_key(way, prices), strict=True))
        if best is None or _rounded(k) < _rounded(best[0]):
            best = (k, [*way[:-1], *points])
    if best is None:
        return None
    kept = [q for i, q in enumerate(best[1]) if not i or abs(q[0] - best[1][i - 1][0]) > 1e-9]
    return kept, best[0][0]


def _rounded(key: tuple) -> tuple:
    return round(key[0], 9), round(key[1], 9), key[2]


def optimise(length: float, crossings: list[dict], price: float) -> tuple[list, float] | None:
    """``search`` for one price, both ends at the normal depth unless a crossing covers them."""
    begins, ends = any(c["lo"] <= 0 for c in crossings), any(c["hi"] >= length for c in crossings)
    return search(length, crossings, [(length, price)], None if begins else NORMAL, None if ends else NORMAL)


def plan_chains(chains: DataFrame) -> DataFrame:
    """chains: chain, length_m, price, lo, hi, kind, new_height, top, height, gap, cover; one row for each crossing (lo null: none)."""

    def kernel(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for chain, length, price, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                crossings = [{"lo": c["lo"], "hi": c["hi"], "options": options(c["kind"], c["new_height"], c["top"], c["height"], c["gap"], c["cover"])} for c in found if c["lo"] is not None]
                done = optimise(length, crossings, price)
                if done is None:
                    rows.append((chain, None, None, None, None, False))
                else:
                    rows += [(chain, i, int(s * 1000 + 0.5), int(h * 1000 + 0.5), int(done[1] + 0.5), True) for i, (s, h) in enumerate(done[0])]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chain", "seq", "s_mm", "h_mm", "cost", "feasible"])

    from pyspark.sql import functions as F

    from . import copies
    from .shared import table

    crossing = F.struct("lo", "hi", "kind", "new_height", "top", "height", "gap", "cover")
    # The order of crossings means nothing to the search, so chains with the same ones are alike.
    each = chains.groupBy("chain").agg(F.first("length_m").alias("length_m"), F.first("price").alias("price"), F.sort_array(F.collect_list(crossing)).alias("found"))
    whole = F.struct("length_m", "price", "found")
    each = table(each.withColumns({"_h1": F.xxhash64(whole), "_h2": F.xxhash64(F.lit(7), whole)}), "chains")
    classes, lists = copies.folded(each, "chain", ["_h1", "_h2"])
    one = each.join(classes.select("chain").hint("merge"), "chain", "left_semi")
    planned = table(one.select("chain", "length_m", "price", "found").mapInArrow(kernel, SCHEMA), "profiles")
    return copies.expanded(planned, "chain", lists)


def chained(links: DataFrame) -> DataFrame:
    """Adds chain and ord to links (child, parent, continues, ...): a link that continues goes straight on from its parent link.

    A chain is named by the child of its link nearest to the root; ord counts
    from the far end. Pointers double each round, so a chain of n links takes
    log n rounds.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .shared import table

    known = links.select(F.col("child").alias("_up"))
    at = table(links.join(known, links["parent"] == F.col("_up"), "left").select(F.col("child"), F.when(F.col("continues") & F.col("_up").isNotNull(), F.col("parent")).alias("top"), F.lit(1).alias("steps")), "chained")
    at = at.select("child", F.coalesce("top", "child").alias("top"), F.when(F.col("top").isNull(), 0).otherwise(1).alias("steps"))
    while True:
        far = at.select(F.col("child").alias("top"), F.col("top").alias("_far"), F.col("steps").alias("_more"))
        after = table(at.join(far, "top").select("child", F.col("_far").alias("top"), (F.col("steps") + F.col("_more")).alias("steps"), (F.col("_more") > 0).alias("moved")), "chained")
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    longest = F.max("steps").over(Window.partitionBy("chain"))
    return links.join(at.select("child", F.col("top").alias("chain"), "steps"), "child").withColumn("ord", longest - F.col("steps")).drop("steps")


PROFILES = "chain bigint, points array<struct<s:double,h:double>>, cost double"


def plan_network(links: DataFrame, crossings: DataFrame) -> DataFrame:
    """child, chain, start_mm, end_mm, cost, feasible: depths at both ends of every link of all networks, chains planned from the roots outwards.

    links: child, parent, chain, ord, length_m, price; crossings: child, lo, hi
    (from the link's far end), kind, new_height, top, height, gap, cover. A
    chain that ends at a root lies at the normal depth there; a side branch
    takes the depth of the chain it joins, which must be planned before, so there
    are as many rounds as chains are nested. ``cost`` is a chain's, at its link
    nearest to the root. Chains that can't be planned have no depths, nor
    have those that join them.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .shared import table

    w = Window.partitionBy("chain").orderBy("ord")
    placed = table(links.withColumn("off", F.coalesce(F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), "placed")
    crossed = placed.select("child", "chain", "off").join(crossings, "child").select("chain", F.struct((F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"), "kind", "new_height", "top", "height", "gap", "cover").alias("c"))
    prices = placed.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct((F.col("off") + F.col("length_m")).alias("to"), "price"))).alias("prices"), F.max_by("parent", "ord").alias("node"))
    joins = placed.select(F.col("child").alias("node"), F.col("chain").alias("onto"), F.col("off").alias("at"))
    rows = prices.join(crossed.groupBy("chain").agg(F.collect_list("c").alias("found")), "chain", "left").join(joins, "node", "left")
    waiting = table(rows.select("chain", "prices", "found", "onto", "at"), "waiting")

    def kernel(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for chain, prices, found, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                each = [{"lo": c["lo"], "hi": c["hi"], "options": options(c["kind"], c["new_height"], c["top"], c["height"], c["gap"], c["cover"])} for c in found or []]
                done = search(prices[-1]["to"], each, [(p["to"], p["price"]) for p in prices], None, end)
                out.append({"chain": chain, "points": None if done is None else [{"s": s, "h": h} for s, h in done[0]], "cost": None if done is None else done[1]})
            points = pa.list_(pa.struct([("s", pa.float64()), ("h", pa.float64())]))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chain", pa.int64()), ("points", points), ("cost", pa.float64())]))

    def depth_at(points, s):
        """The level of a profile at a measure."""
        pair = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        part = F.try_element_at(F.filter(pair, lambda e: e["q"]["s"] >= s - 1e-9), F.lit(1))
        share = F.when(part["q"]["s"] > part["p"]["s"], F.least(F.lit(1.0), (s - part["p"]["s"]) / (part["q"]["s"] - part["p"]["s"]))).otherwise(1.0)
        # A chain of no length has one point and no part.
        return F.coalesce(part["p"]["h"] + (part["q"]["h"] - part["p"]["h"]) * share, F.element_at(points, -1)["h"])

    ready = waiting.where("onto IS NULL").withColumn("end", F.lit(NORMAL))
    parts = []
    while True:
        done = table(ready.select("chain", "prices", "found", "end").mapInArrow(kernel, PROFILES), "profiles")
        if done.isEmpty():
            break
        parts.append(done)
        below = waiting.join(done.where("points IS NOT NULL").select(F.col("chain").alias("onto"), "points"), "onto")
        ready = below.withColumn("end", depth_at(F.col("points"), F.col("at"))).drop("points")
    planned = done
    for p in parts:
        planned = planned.unionByName(p)
    out = placed.join(planned, "chain", "left")
    milli = lambda at: F.floor(depth_at(F.col("points"), at) * 1000 + 0.5).cast("bigint")
    top = F.row_number().over(Window.partitionBy("chain").orderBy(F.col("ord").desc())) == 1
    return out.select("child", "chain", milli(F.col("off")).alias("start_mm"), milli(F.col("off") + F.col("length_m")).alias("end_mm"), F.when(top, F.floor(F.col("cost") + 0.5).cast("bigint")).alias("cost"), F.col("points").isNotNull().alias("feasible"))
