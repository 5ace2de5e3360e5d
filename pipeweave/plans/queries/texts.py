"""Id, label and format functions; upload and job tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import text as T
from ...operators import uploads
from ..catalog import query


@query("f53_typed_ids", "consumers", oracle="""SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE true END AS is_numeric, CAST(id AS VARCHAR) AS text FROM consumers""")
def typed_ids(s):
    json = F.expr("CASE id % 3 WHEN 0 THEN concat('\"', id, '\"') WHEN 1 THEN cast(id as string) ELSE concat(id, '.0') END")
    return s.consumers.select("id", T.typed_id(json).alias("i")).select("id", F.col("i.numeric").alias("is_numeric"), "i.text")


@query("f54_type_codes", "restrictions", oracle="SELECT id, restriction_type AS code FROM restrictions")
def type_codes(s):
    return s.restrictions.select("id", T.type_code(F.concat(F.lit("  "), F.upper("restriction_type"), F.lit(" "))).alias("code"))


@query("f56_output_ids", "pieces", oracle="SELECT id, concat('v', variant, '_net_', row_number() OVER (PARTITION BY variant ORDER BY id)) AS out_id FROM pieces")
def output_ids(s):
    n = F.row_number().over(Window.partitionBy("variant").orderBy("id"))
    return s.pieces.select("id", T.output_id(F.col("variant"), "net", n).alias("out_id"))


@query("f57_attachment_keys", "chambers", oracle="SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE concat('L', id, ' @', CAST(floor(x / 7 + 0.5) AS BIGINT), ',', CAST(floor(y / 7 + 0.5) AS BIGINT)) END AS attachment FROM chambers")
def attachment_keys(s):
    return s.chambers.select("id", T.attachment_key(F.when(F.col("id") % 2 == 0, F.col("id")), F.concat(F.lit("L"), "id"), F.col("x") / 7, F.col("y") / 7).alias("attachment"))


@query("f59_label_types", "pieces", oracle="SELECT laying AS crossed_type, count(*)::BIGINT AS n FROM pieces GROUP BY 1")
def label_types(s):
    return s.pieces.groupBy(T.label_type(F.concat("laying", F.lit("#"), "id")).alias("crossed_type")).agg(F.count(F.lit(1)).alias("n"))


@query("f60_modes", "uploads", oracle="SELECT CASE event_type WHEN 'view' THEN 'PLANAR' WHEN 'error' THEN 'DEPTH' WHEN 'signup' THEN 'PLANAR' END AS mode, count(*)::BIGINT AS n FROM uploads GROUP BY 1")
def modes(s):
    given = F.expr("CASE event_type WHEN 'view' THEN ' ' WHEN 'error' THEN 'depth' WHEN 'signup' THEN 'Planar' ELSE '3d' END")
    return s.uploads.groupBy(T.mode(given).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("f61_variant_counts", "consumers", oracle="SELECT id, greatest(1, least(3, id % 6 - 1))::INT AS variants FROM consumers")
def variant_counts(s):
    return s.consumers.select("id", T.variant_count(F.col("id") % 6 - 1).cast("int").alias("variants"))


@query("f62_digests", "uploads", oracle="SELECT event_id, sha256(concat(upload, ':', part)) AS digest FROM uploads")
def digests(s):
    return s.uploads.select("event_id", F.sha2(F.concat_ws(":", "upload", "part"), 256).alias("digest"))


@query("f63_part_sizes", "pieces", oracle="SELECT id, CAST(ceil(length_mm / 8192.0) AS BIGINT) AS parts, least(8192, length_mm - (CAST(ceil(length_mm / 8192.0) AS BIGINT) - 1) * 8192)::BIGINT AS last_size FROM pieces")
def part_sizes(s):
    n = T.part_count(F.col("length_mm"), F.lit(8192))
    return s.pieces.select("id", n.alias("parts"), T.part_size(F.col("length_mm"), F.lit(8192), n - 1).cast("bigint").alias("last_size"))


@query("f65_signatures", "pieces", oracle="SELECT variant, sha256(string_agg(concat(link, ':', length_mm // 5000), '|' ORDER BY concat(link, ':', length_mm // 5000))) AS signature FROM pieces GROUP BY variant")
def signatures(s):
    """Topology of a variant on a 5 m grid."""
    return s.pieces.groupBy("variant").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("link", F.lit(":"), F.expr("length_mm div 5000")))), "|"), 256).alias("signature"))


@query("f69_progress_stages", "uploads", oracle="SELECT event_id, CAST(part AS VARCHAR) AS completed, event_type AS mode FROM uploads")
def progress(s):
    p = T.progress_map(F.format_string("mode=%s; completed=%d; total=7", "event_type", "part"))
    return s.uploads.select("event_id", p["completed"].alias("completed"), p["mode"].alias("mode"))


@query("f70_formats", "pieces", oracle="""SELECT id, CASE WHEN length_mm < 1024 THEN concat(length_mm, ' B') WHEN length_mm < 1048576 THEN printf('%.1f KiB', floor(length_mm / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MiB', floor(length_mm / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS bytes, concat('&lt;', laying, '&gt;') AS escaped FROM pieces""")
def formats(s):
    return s.pieces.select("id", T.byte_size(F.col("length_mm")).alias("bytes"), T.html(F.concat(F.lit("<"), "laying", F.lit(">"))).alias("escaped"))


@query("f58_difference_texts", "pieces", oracle="""SELECT id, concat_ws('; ', CASE WHEN abs(flow_dt - 9000) >= 1 THEN concat('cost ', CASE WHEN flow_dt >= 9000 THEN '+' ELSE '' END, flow_dt - 9000) END, CASE WHEN abs(length_mm - 200000) >= 500 THEN concat('length ', CASE WHEN floor((length_mm - 200000) / 1000.0::DOUBLE + 0.5) >= 0 THEN '+' ELSE '' END, CAST(floor((length_mm - 200000) / 1000.0::DOUBLE + 0.5) AS BIGINT), ' m') END) AS diff FROM pieces""")
def difference_texts(s):
    return s.pieces.select("id", T.difference_text(F.col("flow_dt") - 9000, (F.col("length_mm") - 200000) / 1000).alias("diff"))


@query("s14_csv_cells", "pieces", oracle="SELECT id, CASE id % 4 WHEN 0 THEN concat(chr(39), '=SUM(A1)') WHEN 1 THEN concat(chr(34), 'a;b', chr(34)) WHEN 2 THEN '-5' ELSE concat(chr(34), 'say ', chr(34), chr(34), 'hi', chr(34), chr(34), chr(34)) END AS cell FROM pieces")
def csv_cells(s):
    value = F.expr("CASE id % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN 'a;b' WHEN 2 THEN '-5' ELSE 'say \"hi\"' END")
    return s.pieces.select("id", T.csv_cell(value, F.col("id") % 4 == 2).alias("cell"))


GAPS = """WITH g AS (SELECT upload, ts, event_id, part, CASE WHEN ts - lag(ts) OVER (PARTITION BY upload ORDER BY ts, event_id) < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM uploads), n AS (SELECT *, sum(fresh) OVER (PARTITION BY upload ORDER BY ts, event_id) AS session FROM g)"""


@query("r04_upload_sessions", "uploads", oracle=GAPS + " SELECT upload, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*)::BIGINT AS n FROM n GROUP BY upload, session")
def sessions(s):
    return uploads.sessions(s.uploads)


@query("a20_received_parts", "uploads", oracle="SELECT upload, count(DISTINCT part)::BIGINT AS received, string_agg(DISTINCT CAST(part AS VARCHAR), ',' ORDER BY CAST(part AS VARCHAR)) AS parts FROM uploads WHERE event_type = 'view' GROUP BY upload")
def received(s):
    return uploads.received(s.uploads.where("event_type = 'view'"))


@query("r03_part_conflicts", "uploads", oracle="SELECT upload, part, count(*)::BIGINT AS tries, count(DISTINCT event_type) > 1 AS conflict FROM uploads GROUP BY upload, part")
def conflicts(s):
    return uploads.part_states(s.uploads.withColumn("digest", F.col("event_type")))


@query("r01_job_states", "uploads", oracle="SELECT upload AS job, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' ELSE 'FAILED' END AS status FROM (SELECT upload, event_type, row_number() OVER (PARTITION BY upload ORDER BY ts DESC, event_id DESC) AS k FROM uploads) x WHERE k = 1")
def job_states(s):
    return uploads.latest_states(uploads.as_job_events(s.uploads))


@query("r02_recovery", "uploads", oracle="SELECT upload AS job, CASE WHEN event_type IN ('signup', 'view') THEN 'FAILED' WHEN event_type = 'purchase' THEN 'DONE' ELSE 'FAILED' END AS status, event_type IN ('signup', 'view') AS recovered FROM (SELECT upload, event_type, row_number() OVER (PARTITION BY upload ORDER BY ts DESC, event_id DESC) AS k FROM uploads) x WHERE k = 1")
def recovery(s):
    return uploads.recovered(uploads.latest_states(uploads.as_job_events(s.uploads)))


@query("t05_last_jobs", "uploads", oracle="SELECT event_id, upload FROM uploads ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_jobs(s):
    """The last 50 jobs: the limit is the feature."""
    return s.uploads.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "upload")


@query("t06_stale_jobs", "uploads", oracle="SELECT event_id FROM uploads WHERE event_type IN ('signup', 'view') ORDER BY ts, event_id LIMIT 100")
def stale_jobs(s):
    """The first 100 stale jobs: the limit is the feature."""
    return s.uploads.where("event_type IN ('signup', 'view')").orderBy("ts", "event_id").limit(100).select("event_id")


@query("j25_other_mode_jobs", "uploads", oracle="SELECT a.event_id AS planar, b.event_id AS depth FROM uploads a JOIN uploads b ON a.upload = b.upload AND a.part = b.part AND a.event_type = 'view' AND b.event_type = 'error'")
def other_mode(s):
    a = s.uploads.where("event_type = 'view'").select("upload", "part", F.col("event_id").alias("planar"))
    return a.join(s.uploads.where("event_type = 'error'").select("upload", "part", F.col("event_id").alias("depth")), ["upload", "part"]).select("planar", "depth")


@query("f67_time_to_live", "uploads", oracle="SELECT upload, epoch_us(max(ts) + INTERVAL 24 HOURS) AS expires_us FROM uploads GROUP BY upload")
def time_to_live(s):
    return s.uploads.groupBy("upload").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 24 HOURS")).alias("expires_us"))
