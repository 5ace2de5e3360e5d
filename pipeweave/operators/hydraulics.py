"""Flows and diameters of a forest: the fixed point of monotony and run length.

Links that carry one flow through nodes without a branch form a part, which
has one diameter. A part must serve its flow, be as wide as every part that
flows into it, and no way from a consumer to the root may run through one
diameter for longer than the diameter's table allows; the part in which a run
grows too long takes the next diameter. Which part that is depends on what was raised
before, so one variant is one group and a kernel; variants are small and there
are many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import rules

ROUNDS = 200
SCHEMA = "variant int, child bigint, flow_dt bigint, du int, feasible boolean"


class Parts:
    """The parts of one forest, numbered from the leaves to the roots."""

    def __init__(self, parent: dict, own_flow: dict, length_mm: dict):
        inlets: dict = {}
        for link, node in parent.items():
            inlets.setdefault(node, []).append(link)
        # From the roots down; reversed, every link comes after all that flow into it.
        order = [link for link in parent if parent[link] not in parent]
        for link in order:
            order.extend(inlets.get(link, []))
        order.reverse()
        self.flow = {link: own_flow.get(link, 0) for link in order}
        for link in order:
            if parent[link] in parent:
                self.flow[parent[link]] += self.flow[link]
        self.of: dict = {}
        self.length: list[int] = []
        self.carries: list[int] = []
        for link in order:
            own = inlets.get(link, [])
            if len(own) == 1 and self.flow[own[0]] == self.flow[link]:
                self.of[link] = self.of[own[0]]
                self.length[self.of[link]] += length_mm[link]
            else:
                self.of[link] = len(self.length)
                self.length.append(length_mm[link])
                self.carries.append(self.flow[link])
        self.into: list[int | None] = [None] * len(self.length)
        for link, node in parent.items():
            if node in parent and self.of[node] != self.of[link]:
                self.into[self.of[link]] = self.of[node]


def solve(parent: dict, own_flow: dict, length_mm: dict) -> tuple[dict, dict, bool]:
    """Flow and diameter by link (named by its child); False if no diameter serves.

    ``parent``: node below each link's child; ``own_flow``: of consumers, by the link they hang on.
    """
    widths, capacity, longest = zip(*((row[0], row[1], row[2] * 1000) for row in rules.DU_ROWS), strict=True)
    parts = Parts(parent, own_flow, length_mm)
    level = [next((i for i, most in enumerate(capacity) if q <= most), None) for q in parts.carries]
    if None in level:
        return parts.flow, {}, False

    def told(feasible: bool):
        return parts.flow, {link: widths[level[p]] for link, p in parts.of.items()}, feasible

    def overrun(p: int | None) -> int | None:
        """The first part on the way from part p down to the root whose run is too long."""
        run, of = 0, None
        while p is not None:
            run = run * (level[p] == of) + parts.length[p]
            of = level[p]
            if run > longest[of]:
                return p
            p = parts.into[p]
        return None

    for _ in range(ROUNDS):
        before = list(level)
        for p, q in enumerate(parts.into):
            if q is not None:
                level[q] = max(level[q], level[p])
        for consumer in sorted(own_flow):
            p = overrun(parts.of[consumer])
            if p is not None:
                if level[p] + 1 == len(widths):
                    return told(False)
                level[p] += 1
        if level == before:
            return told(True)
    return told(False)


def fixed_point(links: DataFrame) -> DataFrame:
    """links: variant, child, parent, flow_dt (of the consumer at the child, 0 if none), length_mm."""

    def kernel(group):
        import pandas as pd

        child = group["child"].tolist()
        own = {c: q for c, q in zip(child, group["flow_dt"].tolist(), strict=True) if q > 0}
        flow, du, feasible = solve(dict(zip(child, group["parent"].tolist(), strict=True)), own, dict(zip(child, group["length_mm"].tolist(), strict=True)))
        rows = [(int(group["variant"].iloc[0]), c, flow[c], du.get(c), feasible) for c in child]
        return pd.DataFrame(rows, columns=["variant", "child", "flow_dt", "du", "feasible"]).astype({"du": "Int32"})

    return links.select("variant", "child", "parent", "flow_dt", "length_mm").groupBy("variant").applyInPandas(kernel, SCHEMA)
