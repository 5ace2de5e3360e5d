"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    out = round_trip(common.documents(spark, sf_dir), _public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = common.documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, train=lambda c: common.fold(c, 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir), words=2)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pitman_yor

    docs = common.documents(spark, sf_dir)
    held_out = common.fold("doc_id", 7) == 2
    model = pitman_yor.fit(docs.where(~held_out))
    out = pitman_yor.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    out = dedup_substrings(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import counts

    out = counts(common.documents(spark, sf_dir), _public("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(common.documents(spark, sf_dir))
    base = F.concat(*(pii.listed(k) for k in pii.BASE))
    return found.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.BASE), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.listed("secret")), ",").alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversations

    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = conversations.repair(damaged, copies="copies")
    hashed = conversations.digests(out.turns).withColumnRenamed("conv_id", "hashed_id")
    joined = out.summary.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    out = resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import languages

    docs = common.documents(spark, sf_dir)
    model = languages.fit(docs, train=common.fold("doc_id", 5) != 0)
    out = languages.predict(docs, model)
    return out.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.line AS line, u.pos AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
    LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS pos) u),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.*, h.k IS NOT NULL AND a.doc_id <> h.last AS lost FROM keyed a LEFT JOIN hot h ON a.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}

_KEYED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLES["op8_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_KEYED} AS ws FROM benchmark),
shingled AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, list_slice(ws, i, i + least(5, len(ws)) - 1) AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0) x),
sizes AS (SELECT item_id, count(*) AS n FROM shingled GROUP BY item_id),
lengths AS (SELECT DISTINCT k FROM shingled),
docs AS (SELECT doc_id, {_KEYED} AS ws FROM documents),
own AS (SELECT DISTINCT doc_id, k, list_slice(ws, i, i + k - 1) AS s FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, lengths WHERE len(ws) >= k) x)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared
FROM own JOIN shingled USING (k, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)"""

#: crc32 of a blob's bytes: the table of the reflected polynomial, then a fold over the bytes.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, list_transform(range(8), lambda i: i::BIGINT)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab)"


def _crc(text: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT"


def _arc(to: str, *ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL)) AS {to}"


def _step(frm: str, cost: str, label: str, out: str, condition: str = "true") -> str:
    """A way of the composition: state ``frm`` left by an edit."""
    return f"CASE WHEN {condition} THEN {{'c': {frm}.c + {cost}, 's': {frm}.s || '{label}', 'o': {frm}.o || {out}}} ELSE {{'c': NULL::BIGINT, 's': NULL, 'o': NULL}} END"


def _inserted(source: str, name: str) -> str:
    """Insertions after a place, twice: no third one can be on a cheapest path."""
    u, a = "[{'role': 'user', 'text': ''}]", "[{'role': 'assistant', 'text': ''}]"
    one = lambda src, out: (f"{out} AS (SELECT * EXCLUDE (q0, q1, q2, q3), q0, q1, {_arc('q2', 'q2', _step('q0', '5', 'I', u), _step('q1', '5', 'I', u), _step('q3', '5', 'I', u))}, "  # noqa: E731
                            f"{_arc('q3', 'q3', _step('q2', '5', 'I', a))} FROM {src})")
    return one(source, f"{name}_1") + ", " + one(f"{name}_1", name)


_NONE = "{'c': NULL::BIGINT, 's': NULL::VARCHAR, 'o': NULL::STRUCT(role VARCHAR, text VARCHAR)[]}"
_MORE = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_OWN, _USER, _ASSISTANT = "[{'role': role, 'text': text}]", "[{'role': 'user', 'text': text}]", "[{'role': 'assistant', 'text': text}]"
_STAYS = "fault NOT IN ('blank', 'duplicate')"
#: States: q0 before all, q1 after a system turn, q2 after a user's, q3 after an assistant's. One round of the recursion a turn.
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, {_crc('k')} % 20 AS kind FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, u.n
  FROM kinds, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n) u),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
ids AS (SELECT DISTINCT conv_id FROM conversations),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
    count(*) FILTER (fault = 'truncated')::BIGINT AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
begun AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': '', 'o': []::STRUCT(role VARCHAR, text VARCHAR)[]}} AS q0, {_NONE} AS q1, {_NONE} AS q2, {_NONE} AS q3 FROM ids),
{_inserted('begun', 'opened')},
paths AS (
  SELECT conv_id, i, q0, q1, q2, q3 FROM opened
  UNION ALL
  SELECT conv_id, i, q0, q1, q2, q3 FROM (
    WITH moved AS (
      SELECT p.conv_id, p.i + 1 AS i, {_arc('q0', _step('q0', '2', 'D', '[]'))}, {_arc('q1', _step('q1', '2', 'D', '[]'), _step('q0', _MORE, 'K', _OWN, f"{_STAYS} AND initial = 's'"))},
        {_arc('q2', _step('q2', '2', 'D', '[]'), *(w for q in ('q0', 'q1', 'q3') for w in (_step(q, _MORE, 'K', _OWN, f"{_STAYS} AND initial = 'u'"), _step(q, '1 + ' + _MORE, 'R', _USER, _STAYS))))},
        {_arc('q3', _step('q3', '2', 'D', '[]'), _step('q2', _MORE, 'K', _OWN, f"{_STAYS} AND initial = 'a'"), _step('q2', '1 + ' + _MORE, 'R', _ASSISTANT, _STAYS))}
      FROM paths p JOIN judged t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1),
    {_inserted('moved', 'ended')}
    SELECT * FROM ended)),
best AS (
  SELECT p.conv_id, f.n IS NOT NULL AS some, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    list_min(list_filter([q0, q3], lambda x: x.c IS NOT NULL)) AS w
  FROM paths p LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(f.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, w.c AS cost, w.s AS audit, sha256(array_to_string(list_transform(w.o, lambda x: x.role || ':' || x.text), chr(10))) AS repaired_sha256 FROM best"""

_FEATURES = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op12_importance_resampling"] = f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, row_number() OVER () AS r, {_FEATURES} AS ws FROM documents),
bench AS (SELECT {_FEATURES} AS ws FROM benchmark),
own AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM docs) x GROUP BY r, w),
theirs AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM bench) x GROUP BY w),
known AS (SELECT w, {_crc('w')} % 10000 AS b FROM (SELECT w FROM own UNION SELECT w FROM theirs) x, crc),
source AS (SELECT b, sum(n)::DOUBLE AS s FROM own JOIN known USING (w) GROUP BY b),
target AS (SELECT b, sum(n)::DOUBLE AS t FROM theirs JOIN known USING (w) GROUP BY b),
alls AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all),
gains AS (SELECT x.b, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN source USING (b) LEFT JOIN target USING (b), alls),
weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM own JOIN known USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, r, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r)::BIGINT AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
