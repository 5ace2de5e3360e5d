"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so resemblance says little; containment of
the item in the document is searched instead. Items are partitioned by the
size of their shingle set (powers of two). An item's sketch holds the shingles
that are smallest under a hash; in a document that contains a share of the
item as many of them are found as in a draw without replacement. Each
partition has a sketch size of its own and a number of hits that a document
must reach: the largest one that containment at the threshold misses with a
probability of 1e-9 at most at any size of the partition. Partitions whose
items have no more shingles than the sketch hold all of them, exactly.
Candidates are verified on the full sets of words.

Items are sketched by Spark tasks and stay in tables; items of one text count
once until the end. One scan of the documents, for any number of items, keeps
the shingles that a Bloom filter of the sketches' hashes lets pass (two probes,
512 bits a hash, ``MOST_BITS`` at most) and only documents that have as many of
them as the least demanding item needs. Of an item's sketch only the hashes
that fewest items share meet the documents in a join, as many as no document
with enough hits can miss all of; the hits are then counted for these pairs
alone, so a phrase that stands in many items joins nothing unless it must.
Texts are shuffled only for candidates.

Defined results: items and documents without words match nothing; an item of
fewer words than a shingle is one shingle of its whole sequence; a null id is
kept as null; repeated rows are searched each for itself; with an empty table
the result is empty; other columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_hashes import make_hasher, shingled

PERMUTATIONS = 32
MISS = 1e-9
#: Bits of the filter of sketch hashes that goes to every task: 16 MB at most; beyond some 260,000 hashes more shingles pass.
LEAST_BITS, MOST_BITS, BITS_A_HASH = 1 << 20, 1 << 27, 512


def sketch_size(partition: int, permutations: int) -> int:
    """Shingles in the sketch of an item with at most 2**partition shingles: longer items have longer ones."""
    return permutations + 8 * max(0, partition - 8)


@lru_cache(maxsize=None)
def needed(partition: int, permutations: int, percent: int) -> int:
    """Sketch hits that every item of this size partition needs."""
    from math import ceil, comb

    s = sketch_size(partition, permutations)

    def at(n: int) -> int:
        k, below = ceil(n * percent / 100), 0.0
        if n <= s:
            return max(1, k)
        for hits in range(s + 1):
            below += comb(k, hits) * comb(n - k, s - hits) / comb(n, s)
            if below > MISS:
                return max(1, hits)
        return s

    if partition <= 9:
        return min(map(at, range((1 << partition - 1) + 1, (1 << partition) + 1) if partition else [1]))
    # Far below its mean a draw without replacement is less likely than one with replacement (Uhlmann 1966), so the binomial law bounds all larger items.
    p, below = percent / 100, 0.0
    for hits in range(s + 1):
        below += comb(s, hits) * p**hits * (1 - p) ** (s - hits)
        if below > MISS:
            return max(1, hits)
    return s


def _sketches(items: DataFrame, words: int, percent: int, permutations: int) -> DataFrame:
    """uid, k, need, h: the sketch of each item of ``items`` (uid, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher, u = make_hasher(), np.uint64
        for b in batches:
            h, owner = hasher([(t or "").encode() for t in b.column(1).to_pylist()])
            counts = np.bincount(owner, minlength=b.num_rows)
            ends = np.cumsum(counts)
            rows, ks, needs, hashes = [], [], [], []
            for row, (a, e) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                if a == e:
                    continue
                k = min(words, e - a)
                own = np.unique(shingled(h[a:e], owner[a:e], k)[0])
                partition = (len(own) - 1).bit_length()
                chosen = own[np.argsort((own ^ (own >> u(31))) * u(0xD6E8FEB86659FD93), kind="stable")[:sketch_size(partition, permutations)]]
                rows += [row] * len(chosen)
                ks += [k] * len(chosen)
                needs += [max(1, -(-len(own) * percent // 100)) if len(chosen) == len(own) else needed(partition, permutations, percent)] * len(chosen)
                hashes.append(chosen)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=u)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ks, pa.int32()), pa.array(needs, pa.int32()), pa.array(flat.view(np.int64))], ["uid", "k", "need", "h"])

    return items.mapInArrow(run, "uid bigint, k int, need int, h bigint")


def _probes(h: str, bits: int) -> list[str]:
    """SQL: the two places of a hash in the filter."""
    return [f"({h} & {bits - 1}L)", f"(shiftrightunsigned({h}, 32) & {bits - 1}L)"]


def _filter(sketches: DataFrame) -> bytes:
    """A Bloom filter of the sketch hashes; at most MOST_BITS / 64 rows of eight bytes come to the driver."""
    import numpy as np

    n = sketches.select("h").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_A_HASH - 1).bit_length() if n else LEAST_BITS))
    out = np.zeros(bits // 64, dtype=np.int64)
    at = sketches.selectExpr(f"explode(array({', '.join(_probes('h', bits))})) AS at")
    rows = at.selectExpr("cast(shiftright(at, 6) as int) AS word", "shiftleft(1L, cast(at & 63L as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.tobytes()


def _probing(sketches: DataFrame) -> DataFrame:
    """h, uid: of each sketch the hashes that fewest items hold, one more than a candidate may lack."""
    from pyspark.sql import Window

    shared = sketches.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = sketches.join(shared, F.col("h") == F.col("_h")).withColumn("_k", F.row_number().over(Window.partitionBy("uid").orderBy("_n", "h")))
    return ranked.withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy("uid"))).where("_k <= _s - need + 1").select("h", "uid")


def _found(docs: DataFrame, columns: list, text: str, items: DataFrame, item_columns: list, item_text: str, words: int, percent: int, permutations: int) -> DataFrame:
    """``columns`` of the documents, ``item_columns`` of the items they contain, n_item_shingles, n_shared."""
    spark = docs.sparkSession
    common.small_batches(spark)
    all_items = items.select(*item_columns, items[item_text].alias("item_text"), F.md5(items[item_text].cast("binary")).alias("item_name"))
    names = [c for c in all_items.columns if c not in ("item_text", "item_name")]
    once = all_items.where("item_name IS NOT NULL").groupBy("item_name").agg(F.first("item_text").alias("item_text"))
    benchmark = common.table(once.withColumn("uid", F.monotonically_increasing_id()), "items")
    sketches = common.table(_sketches(benchmark.select("uid", "item_text"), words, percent, permutations), "sketches")
    lengths = [r["k"] for r in sketches.select("k").distinct().collect()]  # at most ``words`` numbers
    least = sketches.agg(F.min("need")).first()[0] or 1
    passing = _filter(sketches)
    whole = docs.select(*columns, docs[text].alias("text"))
    place = len(whole.columns) - 1

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        hasher, u = make_hasher(), np.uint64
        bits = np.frombuffer(passing, dtype=u)
        mask = u(len(bits) * 64 - 1)

        def passes(at):
            return (bits[(at >> u(6)).astype(np.int64)] >> (at & u(63))) & u(1) > 0

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            h, owner = hasher([(t or "").encode() for t in b.column(place).to_pylist()])
            keys, rows = [], []
            for k in lengths:
                z, o = shingled(h, owner, k)
                ok = np.flatnonzero(passes(z & mask))
                ok = ok[passes((z[ok] >> u(32)) & mask)]
                keys.append(z[ok])
                rows.append(o[ok])
            key, row = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, rows))
            order = np.lexsort((key, row))
            key, row = key[order].astype(np.uint64, copy=False), row[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, dtype=bool)
            key, row = key[new], row[new]
            there, count = np.unique(row, return_counts=True)
            enough = count >= least
            held = np.repeat(enough, count)
            key, there, count = key[held], there[enough], count[enough]
            ids = np.arange(number, number + len(there))
            number += len(there)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(key.view(np.int64)))
            taken = [c.take(pa.array(there.astype(np.int64))) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists, *taken], ["doc_uid", "keys", *b.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    # Written before it is read twice, so the numbers of its rows stay.
    hits = common.table(whole.mapInArrow(scan, f"doc_uid bigint, keys array<bigint>, {fields}"), "hits")
    met = hits.select("doc_uid", F.explode("keys").alias("h")).join(_probing(sketches), "h").select("doc_uid", "uid").distinct()
    whole_sketches = sketches.groupBy("uid").agg(F.collect_list("h").alias("sketch"), F.max("need").alias("need"))
    counted = met.join(hits.select("doc_uid", "keys"), "doc_uid").join(whole_sketches, "uid").where("size(array_intersect(keys, sketch)) >= need").select("doc_uid", "uid")
    pairs = counted.join(benchmark, "uid").join(hits.drop("keys"), "doc_uid")
    own = whole.columns[:-1]

    def verify(batches):
        import pyarrow as pa

        last, tokens = object(), []
        for b in batches:
            keep, sizes, shared = [], [], []
            for row, (item, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if t != last:
                    last, tokens = t, t.encode().lower().split()
                q = item.encode().lower().split()
                k = min(words, len(q))
                mine = set(zip(*(q[i:] for i in range(k))))
                both = len(mine.intersection(zip(*(tokens[i:] for i in range(k)))))
                if 100 * both >= percent * len(mine):
                    keep.append(row)
                    sizes.append(len(mine))
                    shared.append(both)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[2:]), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], [*b.schema.names[2:], "n_item_shingles", "n_shared"])

    out = pairs.select("item_text", "text", *own, "item_name")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[2:])
    found = out.mapInArrow(verify, f"{fields}, n_item_shingles bigint, n_shared bigint")
    return found.join(all_items.select("item_name", *names), "item_name").select(*own, *names, "n_item_shingles", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared of every contained item."""
    return _found(docs, [docs[doc_id].alias("doc_id")], text, items, [items[item_id].alias("item_id")], item_text, words, percent, permutations)


def clean_documents(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item.

    What a row contains is told by its text, so texts that contain an item are named by 96 bits and left out.
    """
    name = lambda c: [F.xxhash64(c).alias("leak_1"), F.hash(c).alias("leak_2")]
    leaks = common.table(_found(docs, name(docs[text]), text, items, [], item_text, words, percent, permutations).select("leak_1", "leak_2").distinct(), "leaks")
    one, two = name(docs[text])
    return docs.join(leaks, (one == leaks["leak_1"]) & (two == leaks["leak_2"]), "left_anti")
