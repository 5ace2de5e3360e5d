"""A synthetic scene over the driver's tables, as SQL that Spark and DuckDB share.

The scene exercises operators; it doesn't represent an engineering design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import rules

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS = {
    "consumers": """SELECT c_custkey AS id, CAST((c_custkey * 7919) % 20000 AS DOUBLE) / 10 AS x, CAST((c_custkey * 104729) % 60000 AS DOUBLE) / 10 AS y,
        CAST(floor(abs(c_acctbal)) AS BIGINT) % 2000 + 10 AS flow_dt FROM {customer}""",
    "net_lines": """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(0 AS DOUBLE) AS ax, CAST(n_nationkey * 240 AS DOUBLE) AS ay,
        CAST(2000 AS DOUBLE) AS bx, CAST(n_nationkey * 240 AS DOUBLE) AS by_, CAST(50 + (n_nationkey * 37) % 1350 AS INT) AS diameter FROM {nation}""",
    "chambers": "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey * 6131) % 2000 AS DOUBLE) AS x, CAST(s_nationkey * 240 AS DOUBLE) AS y FROM {supplier}",
    "restrictions": """SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 12 AS INT) AS type_ix,
        CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'oks' WHEN 1 THEN 'park' WHEN 2 THEN 'social_area' WHEN 3 THEN 'prohibited_site' WHEN 4 THEN 'water' WHEN 5 THEN 'railway'
          WHEN 6 THEN 'road' WHEN 7 THEN 'tram_tracks' WHEN 8 THEN 'gas_pipeline' WHEN 9 THEN 'power_cable' WHEN 10 THEN 'heat_network' ELSE 'unlisted' END AS restriction_type,
        CAST((p_partkey * 3571) % 2000 AS DOUBLE) AS xmin, CAST((p_partkey * 9973) % 6000 AS DOUBLE) AS ymin,
        CAST((p_partkey * 3571) % 2000 + p_size AS DOUBLE) AS xmax, CAST((p_partkey * 9973) % 6000 + p_size AS DOUBLE) AS ymax FROM {part}""",
    "links": """SELECT c.id AS child, p.id AS parent, c.flow_dt, c.x AS ax, c.y AS ay, p.x AS bx, p.y AS by_,
        CAST(floor(sqrt((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y)) * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS length_mm
        FROM {consumers} c JOIN {consumers} p ON p.id = CAST(floor((c.id - 1) / 2) AS BIGINT) WHERE c.id > 0""",
    "pieces": """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey % 5 AS INT) AS variant, CAST(floor(o_totalprice) AS BIGINT) % 20000 + 10 AS flow_dt,
        CAST((o_orderkey * 7919) % 400000 + 1000 AS BIGINT) AS length_mm, o_orderstatus AS laying, CAST(o_custkey AS BIGINT) AS link,
        CAST((o_orderkey * 31) % 2048 AS BIGINT) AS crossed_bits, CAST(500 + (o_orderkey * 17) % 5000 AS BIGINT) AS depth0_mm, CAST(500 + (o_orderkey * 29) % 5000 AS BIGINT) AS depth1_mm FROM {orders}""",
    "vertices": """SELECT id, k, CAST((id * 7919 + k * k * 1313 + k * 37) % 2000 AS DOUBLE) / 10 AS x, CAST((id * 104729 + k * 977) % 6000 AS DOUBLE) / 10 AS y
        FROM (SELECT c_custkey AS id FROM {customer}) c CROSS JOIN (SELECT CAST(column1 AS INT) AS k FROM (VALUES (0), (1), (2), (3), (4), (5)) AS v(column1)) v""",
    "sections": """SELECT CAST(l_orderkey AS BIGINT) AS link, CAST(l_linenumber AS BIGINT) AS obstacle, CAST(min((l_partkey * 13) % 400) AS DOUBLE) AS s0,
        CAST(min((l_partkey * 13) % 400) + max(l_quantity) AS DOUBLE) AS s1, CAST(100 + (l_linenumber * 15) % 80 AS BIGINT) AS kspec_pct FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "out_lines": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('v', CAST(1 + o_orderkey % 3 AS VARCHAR(3))) END AS variant,
        CASE WHEN o_orderkey % 89 = 0 THEN 'pipe' ELSE 'heat_network' END AS object_type, CASE WHEN o_orderkey % 83 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS out_id,
        CAST(o_orderkey AS BIGINT) AS start_node, CASE WHEN o_orderkey % 53 = 0 THEN CAST(-7 AS BIGINT) ELSE CAST(floor((o_orderkey - 1) / 2) AS BIGINT) END AS end_node,
        CASE WHEN o_orderkey % 61 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) % 20000 + 10 END AS flow_dt,
        CAST(CASE WHEN o_orderkey % 59 = 0 THEN 110 WHEN o_orderkey % 5 = 0 THEN 300 WHEN o_orderkey % 5 = 1 THEN 500 ELSE 700 END AS INT) AS du,
        CAST((o_orderkey * 7919) % 400000 + 1000 AS BIGINT) AS true_mm, CAST((o_orderkey * 7919) % 400000 + 1000 + CASE WHEN o_orderkey % 47 = 0 THEN 30 WHEN o_orderkey % 43 = 0 THEN 15 ELSE 0 END AS BIGINT) AS length_mm,
        CASE WHEN o_orderkey % 67 = 0 THEN 'air' WHEN o_orderkey % 4 = 0 THEN 'special' ELSE 'base' END AS laying, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 160 ELSE 100 END AS BIGINT) AS kspec_pct,
        CASE WHEN o_orderkey % 71 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(500 + (o_orderkey * 17) % 5000 AS BIGINT) END AS depth0_mm, CAST(500 + (o_orderkey * 17) % 5000 + CASE WHEN o_orderkey % 37 = 0 THEN 20000 ELSE (o_orderkey % 3) * 40 END AS BIGINT) AS depth1_mm,
        CASE WHEN o_orderkey % 4 = 0 THEN CASE CAST(o_orderkey % 20 AS INT) WHEN 0 THEN 'road' WHEN 4 THEN 'tram_tracks' WHEN 8 THEN 'gas_pipeline' WHEN 12 THEN 'power_cable' ELSE 'heat_network' END END AS crossed_type, CAST((o_orderkey * 13) % 100 AS BIGINT) AS angle FROM {orders}""",
    "out_nodes": """SELECT CAST(c_custkey AS BIGINT) AS id, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'consumer' WHEN 1 THEN 'technical_node' WHEN 2 THEN 'heat_chamber' ELSE 'existing_chamber' END AS kind,
        CAST(CASE WHEN c_custkey % 5 = 0 THEN 300 ELSE 700 END AS INT) AS du, CAST(CASE WHEN c_custkey % 5 = 0 THEN 5000000 WHEN c_custkey % 31 = 0 THEN 1 ELSE 8000000 END AS BIGINT) AS cost FROM {customer}""",
    "rings": """SELECT CAST(p_partkey AS BIGINT) AS poly, r.ring, d.k, CAST((p_partkey * 3571) % 2000 + d.dx * CASE WHEN r.ring = 0 THEN 4 + (p_partkey * 13 + d.k * d.k * 7) % 20 ELSE 2 END AS DOUBLE) AS ax,
        CAST((p_partkey * 9973) % 6000 + d.dy * CASE WHEN r.ring = 0 THEN 4 + (p_partkey * 13 + d.k * d.k * 7) % 20 ELSE 2 END AS DOUBLE) AS ay,
        CAST((p_partkey * 3571) % 2000 + d.nx * CASE WHEN r.ring = 0 THEN 4 + (p_partkey * 13 + ((d.k + 1) % 8) * ((d.k + 1) % 8) * 7) % 20 ELSE 2 END AS DOUBLE) AS bx,
        CAST((p_partkey * 9973) % 6000 + d.ny * CASE WHEN r.ring = 0 THEN 4 + (p_partkey * 13 + ((d.k + 1) % 8) * ((d.k + 1) % 8) * 7) % 20 ELSE 2 END AS DOUBLE) AS by_
        FROM {part} CROSS JOIN (VALUES (0), (1)) AS r(ring) CROSS JOIN (VALUES (0, 1, 0, 1, 1), (1, 1, 1, 0, 1), (2, 0, 1, -1, 1), (3, -1, 1, -1, 0), (4, -1, 0, -1, -1), (5, -1, -1, 0, -1), (6, 0, -1, 1, -1), (7, 1, -1, 1, 0)) AS d(k, dx, dy, nx, ny)
        WHERE r.ring = 0 OR p_partkey % 3 = 0""",
    "zones": """SELECT r.id AS poly, r.restriction_type, u.kind, u.min_angle, u.extent_m, u.kspec_pct, CASE WHEN r.restriction_type = 'oks' THEN CAST(5 AS DOUBLE) ELSE u.clearance_mm / CAST(1000 AS DOUBLE) END + CAST(0.255 AS DOUBLE) + u.width_mm / CAST(2000 AS DOUBLE) AS need
        FROM {restrictions} r JOIN {rules} u ON u.restriction_type = r.restriction_type""",
    "legs": """SELECT a.id AS chain, a.k, CAST(floor(a.k / 2) AS INT) AS line, (a.id + CAST(floor(a.k / 2) AS INT)) % 3 = 0 AS special, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM {vertices} a JOIN {vertices} b ON b.id = a.id AND b.k = a.k + 1""",
    "uploads": """SELECT CAST(user_id AS BIGINT) AS upload, CAST(event_id AS BIGINT) % 7 AS part, event_type, ts, CAST(event_id AS BIGINT) AS event_id FROM {events}""",
}
for _name in ("du_table", "rules", "vertical_rules", "chamber_cost", "strategies"):
    VIEWS[_name] = rules.as_sql(_name)

_NEEDS = {n: [m for m in [*VIEWS, *TABLES] if "{" + m + "}" in q] for n, q in VIEWS.items()}


class Scene:
    """The scene's DataFrames by name; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in [*VIEWS, *TABLES]:
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._known[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in _NEEDS[name]})
        return self._known[name]


def with_sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the named views of the scene before it, for the oracle."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            if m in VIEWS:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    views = [f"{n} AS ({VIEWS[n].format(**{m: m for m in [*VIEWS, *TABLES]})})" for n in order]
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return head + ", ".join([*views, body[5:]])
    return (head + ", ".join(views) + " " if views else "") + body
