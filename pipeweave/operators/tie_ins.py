"""Tie-in candidates: existing chambers with the slots their lines take, and new chambers on network lines.

A line offers its vertices, the foot of every consumer and of every box corner
within ``PROJECTION_M``, points just outside the boxes it passes, and a sample
every ``STEP_M``, in this order. Left out are points inside a box, within
``rules.SNAP_M`` of a usable chamber, within ``DEDUPE_M`` of a point taken
before, and those without a free slot. A chamber on no line counts as one that
a line passes. Which point is taken depends on those before it, so the choice
is a kernel, one scene a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import rules

NODE_M, STEP_M, DEDUPE_M, PROJECTION_M, CORRIDOR_M = 0.5, 4.0, 1.0, 60.0, 0.3
#: Slots taken at a chamber whose lines are not in the input.
UNKNOWN_DEGREE = 2


def degree(x: float, y: float, lines: list) -> int:
    """Slots that lines take at a point: one if it ends there, two if it passes or begins and ends there."""
    import numpy as np

    near = lambda p: (p[0] - x) ** 2 + (p[1] - y) ** 2 <= NODE_M * NODE_M
    taken = 0
    for line in lines:
        ends = near(line[0]) + near(line[-1])
        if not ends:
            _, _, d = feet(np.array([[x, y]]), line)
            ends = 2 if d.min() <= NODE_M else 0
        taken += ends
    return taken


def feet(points, line):
    """Nearest point of a line to each point, and the distance."""
    import numpy as np

    a, b = line[:-1], line[1:]
    d = b - a
    n2 = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((points[:, None, :] - a) * d).sum(axis=2) / n2, 0, 1)
    at = a + t[:, :, None] * d
    gap = np.hypot(at[:, :, 0] - points[:, None, 0], at[:, :, 1] - points[:, None, 1])
    best, rows = gap.argmin(axis=1), np.arange(len(points))
    return at[rows, best, 0], at[rows, best, 1], gap[rows, best]


def offered(line, consumers, boxes):
    """Points that one line offers, in their order."""
    import numpy as np

    out = [tuple(p) for p in line]
    if len(consumers):
        x, y, _ = feet(consumers, line)
        out += zip(x, y, strict=True)
    if len(boxes):
        corners = boxes[:, [0, 1, 0, 3, 2, 1, 2, 3]].reshape(-1, 2)
        x, y, d = feet(corners, line)
        out += zip(x[d <= PROJECTION_M], y[d <= PROJECTION_M], strict=True)
    for a, b in zip(line, line[1:]):
        n = float(np.hypot(*(b - a)))
        if n == 0:
            continue
        for box in boxes:
            lo, hi = 0.0, 1.0
            for i in (0, 1):
                d = b[i] - a[i]
                if d == 0:
                    lo, hi = (lo, hi) if box[i] <= a[i] <= box[i + 2] else (1.0, 0.0)
                else:
                    s, t = sorted(((box[i] - a[i]) / d, (box[i + 2] - a[i]) / d))
                    lo, hi = max(lo, s), min(hi, t)
            if lo < hi:
                out += [tuple(a + (b - a) * t) for t in (max(0.0, lo - CORRIDOR_M / n), min(1.0, hi + CORRIDOR_M / n))]
    for a, b in zip(line, line[1:]):
        n = float(np.hypot(*(b - a)))
        out += [tuple(a + (b - a) * (k * STEP_M / n)) for k in range(1, int(n // STEP_M) + 1) if n - k * STEP_M >= 0.3 * STEP_M]
    return out


def candidates(consumers, chambers: list, boxes, lines: list) -> tuple[list, list]:
    """Degrees of the chambers (id, x, y), and (x, y, degree) of new chambers on lines."""
    import numpy as np

    consumers, boxes = np.asarray(consumers, dtype=float).reshape(-1, 2), np.asarray(boxes, dtype=float).reshape(-1, 4)
    inside = lambda x, y: bool(((boxes[:, 0] < x) & (x < boxes[:, 2]) & (boxes[:, 1] < y) & (y < boxes[:, 3])).any())
    degrees = [degree(x, y, lines) or UNKNOWN_DEGREE for _, x, y in chambers]
    usable = [(x, y) for (_, x, y), n in zip(chambers, degrees, strict=True) if n < rules.MAX_DEGREE and not inside(x, y)]
    taken: dict[tuple, list] = {}
    out = []
    for line in lines:
        for x, y in offered(line, consumers, boxes):
            if inside(x, y) or any((x - u) ** 2 + (y - v) ** 2 <= rules.SNAP_M**2 for u, v in usable):
                continue
            cx, cy = int(x // DEDUPE_M), int(y // DEDUPE_M)
            if any((x - u) ** 2 + (y - v) ** 2 < DEDUPE_M**2 for i in (-1, 0, 1) for j in (-1, 0, 1) for u, v in taken.get((cx + i, cy + j), ())):
                continue
            n = degree(x, y, lines)
            if 0 < n < rules.MAX_DEGREE:
                taken.setdefault((cx, cy), []).append((x, y))
                out.append((float(x), float(y), n))
    return degrees, out


def with_tie_ins(features: DataFrame, segments: DataFrame) -> DataFrame:
    """``features`` of the planner with the chambers' degrees and rows of kind tie_in; their ids follow the scene's largest."""
    schema = features.schema

    def kernel(left, right):
        import numpy as np
        import pandas as pd

        if not len(left):
            return left
        left = left.sort_values(["kind", "id"], ignore_index=True)
        lines = []
        for _, part in right.sort_values(["line", "part", "k"]).groupby(["line", "part"]):
            lines.append(np.array([*zip(part["ax"], part["ay"], strict=True), (part["bx"].iloc[-1], part["by_"].iloc[-1])]))
        is_root, is_box = left["kind"] == "root", left["kind"].isin(["box", "building"])
        chambers = list(left.loc[is_root, ["id", "x", "y"]].itertuples(index=False, name=None))
        degrees, found = candidates(left.loc[left["kind"] == "consumer", ["x", "y"]].to_numpy(), chambers, left.loc[is_box, ["x", "y", "x1", "y1"]].to_numpy(), lines)
        left.loc[is_root, "degree"] = np.array(degrees, dtype=left["degree"].dtype)
        first = int(max(left["id"].max(), right["line"].max() if len(right) else 0)) + 1
        new = pd.DataFrame([(left["scene"].iloc[0], "tie_in", first + i, x, y, 0.0, 0.0, 0, n) for i, (x, y, n) in enumerate(found)], columns=["scene", "kind", "id", "x", "y", "x1", "y1", "flow_dt", "degree"])
        return pd.concat([left[list(new.columns)], new.astype(left[list(new.columns)].dtypes.to_dict())], ignore_index=True)[[f.name for f in schema]] if len(new) else left[[f.name for f in schema]]

    return features.groupBy("scene").cogroup(segments.groupBy("scene")).applyInPandas(kernel, schema)
