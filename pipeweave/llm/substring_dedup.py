"""Substring dedup of word windows by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash
of the ``kmer`` words long sequences in it. Consecutive windows of a document
that share their minimiser form a super-k-mer. Equal windows have equal
minimisers, so a minimiser met in one document only can't hold a repeat: such
super-k-mers are left out first, on a table of (minimiser, document, place).
The others travel as one packed string to the bucket of their minimiser. Equal
strings are summed before they travel. A bucket sorts its windows (128-bit
hashes of the packed words) and finds the smallest document of each exactly.
Minimisers with more than ``hot`` different strings (a passage with other words around
it in very many documents) aren't one bucket: their windows are dealt by the
window's own hash.

A word is removed if a window that covers it also starts in a document with a
smaller id; windows are judged on the input.

Defined results: a null text has no words; rows with a null id lose nothing
and make nothing else lose words; rows that share an id are windows of one
document (they never remove each other's words), each with places of its own,
held apart by a hash of the text; an empty table gives no rows; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
KMER = 8
HOT = 20_000


def make_runs(window: int, kmer: int):
    """A function words -> (minimiser, first window, windows) of each super-k-mer."""
    import numpy as np
    import xxhash

    u, digest = np.uint64, xxhash.xxh3_64_intdigest
    span = window - kmer + 1

    def runs(words: list[bytes]):
        n = len(words) - window + 1
        if n < 1:
            return None
        w = np.fromiter(map(digest, words), dtype=u, count=len(words))
        h = np.zeros(len(w) - kmer + 1, dtype=u)
        for i in range(kmer):
            h += w[i:len(h) + i]
            h *= u(0x9E3779B97F4A7C15)
            h ^= h >> u(32)
        # Sliding minimum by doubling.
        low, size = h, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:n], low[span - size:span - size + n])
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return low[starts].view(np.int64), starts, np.diff(np.append(starts, n))

    return runs


def _super_kmers(docs: DataFrame, window: int, kmer: int, kind: str) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        runs = make_runs(window, kmer)
        for b in batches:
            parts, rows = [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                found = runs((t or "").encode().split())
                if found is not None:
                    parts.append(found)
                    rows.append(np.full(len(found[1]), row))
            if not parts:
                continue
            minimiser, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(np.concatenate(rows))) for c in (0, 2)), pa.array(minimiser), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["doc_id", "own", "minimiser", "start", "windows"])

    return docs.mapInArrow(run, f"doc_id {kind}, own bigint, minimiser bigint, start int, windows int")


def _digests(packed: bytes, window: int):
    """128-bit hash of each window of a packed string, as rows of two numbers."""
    import numpy as np
    import xxhash

    ends = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(packed))
    digest = xxhash.xxh3_128_digest
    view = memoryview(packed)
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts, ends[window - 1:])]), dtype="<u8").reshape(-1, 2)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER, hot: int = HOT) -> DataFrame:
    """doc_id, text (kept words joined by a space), n_words, n_removed; one row for each input row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("own"))
    named = whole.where("doc_id IS NOT NULL AND text IS NOT NULL")

    places, places_path = common.write_table(_super_kmers(named, window, kmer, kind), "super-kmers")
    repeated = places.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimiser")
    kept = places.join(repeated, "minimiser").groupBy("doc_id", "own").agg(F.collect_list(F.struct("minimiser", "start", "windows")).alias("runs"))

    def pack(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            rows, minimisers, starts, packed, keys = [], [], [], [], []
            for row, (t, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                words = t.encode().split()
                for r in found:
                    s, n = r["start"], r["windows"]
                    p = b" ".join(words[s:s + n + window - 1])
                    rows.append(row)
                    minimisers.append(r["minimiser"])
                    starts.append(s)
                    packed.append(p)
                    keys.append(xxhash.xxh3_128_digest(p))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows, pa.int64())) for c in (0, 3)), pa.array(minimisers, pa.int64()), pa.array(starts, pa.int32()), pa.array(packed, pa.binary()), pa.array(keys, pa.binary())],
                                             ["doc_id", "own", "minimiser", "start", "packed", "key"])

    strings = named.join(kept, ["doc_id", "own"]).select("doc_id", "text", "runs", "own").mapInArrow(pack, f"doc_id {kind}, own bigint, minimiser bigint, start int, packed binary, key binary")
    strings = common.table(strings, "packed")
    common.remove(spark, places_path)
    unique, unique_path = common.write_table(strings.groupBy("minimiser", "key", "packed").agg(F.min("doc_id").alias("doc_id")), "packed-once")
    crowded = unique.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("minimiser")
    crowded = common.table(crowded, "hot-minimisers")

    def settle(batches):
        """Batches of one bucket after another: smallest document of each window."""
        import numpy as np
        import pyarrow as pa

        def answer(group):
            digests = [_digests(p, window) for _, p, _ in group]
            sizes = [len(d) for d in digests]
            d = np.concatenate(digests)
            rows = np.repeat(np.arange(len(group)), sizes)
            docs_ = np.array([x for _, _, x in group])
            owner = docs_[rows]
            order = np.lexsort((owner, d[:, 1], d[:, 0]))
            s = d[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])
            first = np.empty(len(s), dtype=owner.dtype)
            first[order] = owner[order][new][np.cumsum(new) - 1]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in group], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(first))], ["key", "first"])

        group, at, size = [], None, 0
        for b in batches:
            for m, k, p, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if m != at and size > 1 << 20:
                    yield answer(group)
                    group, size = [], 0
                at = m
                group.append((k, p, x))
                size += len(p)
        if group:
            yield answer(group)

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k, p, x in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                d = _digests(p, window).astype(np.int64, copy=False).view(np.int64)
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([x] * n, b.schema.field(3).type)], ["key", "j", "w1", "w2", "doc_id"])

    columns = ["minimiser", "key", "packed", "doc_id"]
    cold = unique.join(crowded, "minimiser", "left_anti").select(*columns)
    firsts = cold.repartition(common.partitions(spark), "minimiser").sortWithinPartitions("minimiser").mapInArrow(settle, f"key binary, first array<{kind}>")
    if not crowded.isEmpty():
        each = common.table(unique.join(crowded, "minimiser", "left_semi").select(*columns).mapInArrow(spread, f"key binary, j int, w1 bigint, w2 bigint, doc_id {kind}"), "hot-windows")
        least = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
        again = each.join(least, ["w1", "w2"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "first"))).alias("all"))
        firsts = firsts.unionByName(again.select("key", F.transform("all", lambda x: x["first"]).alias("first")))
    firsts = common.table(firsts, "window-firsts")
    common.remove(spark, unique_path)

    lost = (strings.select("doc_id", "own", "start", "key").join(firsts, "key")
            .select("doc_id", "own", "start", F.expr("transform(first, f -> f < doc_id)").alias("later")).where("exists(later, x -> x)")
            .groupBy(F.col("doc_id").alias("lost_id"), F.col("own").alias("lost_own")).agg(F.collect_set(F.struct("start", "later")).alias("lost")))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts, n_words, n_removed = [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if found:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for r in found:
                        at = np.flatnonzero(r["later"]) + r["start"]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.minimum(at + window, n), -1)
                    keep = (np.cumsum(edge[:n]) == 0).tolist()
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                texts.append(b" ".join(words).decode())
                n_words.append(n)
                n_removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    joined = whole.join(lost, (whole["doc_id"] == lost["lost_id"]) & (whole["own"] == lost["lost_own"]), "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(cut, f"doc_id {kind}, text string, n_words bigint, n_removed bigint")
