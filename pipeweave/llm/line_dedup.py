"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, with A-Z lower-cased,
held as a 128-bit hash. The index is a set of runs: bucketed tables, each
bucket sorted by hash. A new batch of documents is summed to one row per key,
then merge-anti-joined with the runs (equal buckets, so no shuffle of a run):
keys not seen before become a run of their own at level 0, keys seen before go
to a small run of repeats. When a level holds ``fanout`` runs they are merged
into one run of the next level. A key therefore lies in one run only.

Keys found in at least ``min_docs`` documents lose all their lines except in
the largest doc_id that holds them.

Defined results: a null or empty text is one empty line; each row is a
document of its own in the count, and all rows that share the largest doc_id
keep their lines; null ids are one id, smaller than any other; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import WS

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2


def _digests(text: str, min_chars: int):
    """For each line its key's 16-byte digest, or None for a short key."""
    import xxhash

    digest, ws = xxhash.xxh3_128_digest, WS
    out = []
    for line in text.split("\n"):
        key = line.strip(ws)
        out.append(digest(key.encode().lower()) if len(key) >= min_chars else None)
    return out


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2, doc_id: one row for each distinct long key of a document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, keys, counts = b.column(0), [], []
            for t in b.column(1).to_pylist():
                found = {d for d in _digests(t or "", min_chars) if d is not None}
                keys.extend(found)
                counts.append(len(found))
            pairs = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), ids.take(pa.array(rows))], ["h1", "h2", "doc_id"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}")


class LineRuns:
    """The levelled index. Rows of a run: h1, h2, docs, last (largest doc_id)."""

    KEYS = ["h1", "h2"]

    def __init__(self, spark: SparkSession, *, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or common.partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "h1").write.format("parquet").bucketBy(self.buckets, "h1").sortBy("h1", "h2")
           .option("path", common.new_path(self.spark, "runs")).saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        where = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        common.remove(self.spark, where)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of ``keys`` whose key no run holds."""
        for r in self.runs():
            keys = keys.join(self.spark.table(r).select(*self.KEYS), self.KEYS, "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        parts = [keys.join(self.spark.table(r).select(*self.KEYS), self.KEYS, "left_semi") for r in self.runs()]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def add(self, lines: DataFrame) -> None:
        """Add a batch: rows h1, h2, doc_id, one for each key of a document."""
        summed = lines.groupBy(*self.KEYS).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        staged = self._write(summed)
        if not self.runs():
            self.levels[0].append(staged)
            return
        batch = self.spark.table(staged)
        fresh, again = self._write(self.unseen(batch)), self._write(self.seen(batch))
        self.levels[0].append(fresh)
        self.repeats.append(again)
        self._drop(staged)
        self._compact()
        common.free_shuffles(self.spark)

    def _compact(self) -> None:
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                old = self.levels[at]
                merged = self.spark.table(old[0])
                for r in old[1:]:
                    merged = merged.unionByName(self.spark.table(r))
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(merged))
                self.levels[at] = []
                for r in old:
                    self._drop(r)
            at += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, last of the keys that at least ``min_docs`` documents hold."""
        runs = self.spark.table(self.runs()[0])
        for r in self.runs()[1:]:
            runs = runs.unionByName(self.spark.table(r))
        if not self.repeats:
            return runs.where(F.col("docs") >= min_docs).select("h1", "h2", "last")
        more = self.spark.table(self.repeats[0])
        for r in self.repeats[1:]:
            more = more.unionByName(self.spark.table(r))
        more = more.groupBy(*self.KEYS).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        return (runs.join(more, self.KEYS, "left")
                .where(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs)
                .select("h1", "h2", F.greatest("last", "later").alias("last")))

    def close(self) -> None:
        for r in [*self.runs(), *self.repeats]:
            self._drop(r)
        self.levels, self.repeats = [[]], []


def _ranges(docs: DataFrame, doc_id: str, batches: int) -> list:
    """Conditions that split the rows into batches: by ranges of a number, by a hash of any other id."""
    kind = docs.schema[doc_id].dataType.simpleString()
    if batches < 2:
        return [F.lit(True)]
    if kind not in ("bigint", "int", "smallint", "double", "float"):
        return [F.pmod(F.xxhash64(docs[doc_id]), F.lit(batches)) == k for k in range(batches)]
    low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    if low is None or low == high:
        return [F.lit(True)]
    cuts = [low + (high - low) * k // batches for k in range(1, batches)]
    c = docs[doc_id]
    return [(c < cuts[0]) | c.isNull(), *[(c >= a) & (c < b) for a, b in zip(cuts, cuts[1:])], c >= cuts[-1]]


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped; one row for each input row.

    ``rest``: a struct of the other columns, as they were.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    index = LineRuns(spark, fanout=fanout)
    for part in _ranges(docs, doc_id, batches):
        index.add(line_keys(docs.where(part), doc_id, text, min_chars))
    frequent, _ = common.write_table(index.frequent(min_docs), "frequent-lines")
    index.close()
    keys = line_keys(docs, doc_id, text, min_chars)
    lost = (keys.join(frequent, LineRuns.KEYS).where(~F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost")))

    def run(batches_):
        import numpy as np
        import pyarrow as pa

        for b in batches_:
            texts, n_lines, n_dropped = [], [], []
            for t, lost_keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                n_lines.append(len(lines))
                if lost_keys:
                    packed = np.array([(k["h1"], k["h2"]) for k in lost_keys], dtype="<i8").tobytes()
                    drop = {packed[i:i + 16] for i in range(0, len(packed), 16)}
                    kept = [line for line, d in zip(lines, _digests(t or "", min_chars), strict=True) if d not in drop]
                    n_dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    n_dropped.append(0)
                    texts.append(t or "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), b.column(3)], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    others = [docs[c] for c in docs.columns if c not in (doc_id, text)] or [F.lit(None).cast("int").alias("none")]
    whole = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.struct(*others).alias("rest"))
    joined = whole.join(lost, whole["doc_id"].eqNullSafe(lost["lost_id"]), "left").select("doc_id", "text", "lost", "rest")
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint, rest {whole.schema['rest'].dataType.simpleString()}")
