"""Near-duplicate documents by fast similarity sketching and banding.

A document's set of word shingles is sketched in rounds: in each of the first
``coordinates`` rounds every element is hashed to one bin with a value that
counts the round first, later rounds throw all elements at one bin each, and
sketching stops when every bin is filled, which the concentration bounds of
the method place after a few rounds. Groups of coordinates are banded; two
documents that share a band are candidates and are verified on their full
sets of words, not on hashes.

Documents with the same set are folded into one before banding, so copies
never make pairs. In a band bucket every member is compared with the smallest
member and with the one that meets most others. Candidate groups (documents connected by such comparisons) that still hold several
components are compared in blocks: the members outside the group's largest
component against all members, without a row for each pair. Components come
from star contraction. With 32 bands of 4 coordinates a link at the threshold
is no candidate with probability 5e-8.

Defined results: a document without words has no shingles and is linked with
nothing; rows with a null id are linked with nothing (component null, kept);
rows that share an id are one document, linked by any of its texts; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS = 32
ROWS = 4
#: Bytes of text in a block of queries and of members in the comparison of what the stars leave apart.
QUERY_BYTES = 500_000
MEMBER_BYTES = 2_000_000
#: Candidate groups left apart whose sizes may be broadcast.
FEW_GROUPS = 10_000


def make_sketcher(coordinates: int):
    """A function from distinct 64-bit hashes to ``coordinates`` values (a power of two)."""
    import numpy as np

    u = np.uint64
    if coordinates & (coordinates - 1) or coordinates > 128:
        raise ValueError("coordinates: a power of two, 128 at most")
    seeds = (np.arange(1, 2 * coordinates + 1, dtype=u) * u(0x9E3779B97F4A7C15))[:, None]
    turn = (np.arange(2 * coordinates, dtype=u) << u(56))[:, None]
    last_bins = np.arange(2 * coordinates)
    none = np.iinfo(u).max

    def sketch(hashes):
        out = np.full(coordinates, none, dtype=u)
        step = max(1, min(coordinates, 512 // len(hashes)))
        at = 0
        while at < 2 * coordinates:
            to = min(at + step, coordinates if at < coordinates else 2 * coordinates)
            z = hashes[None, :] + seeds[at:to]
            z ^= z >> u(30)
            z *= u(0xBF58476D1CE4E5B9)
            z ^= z >> u(27)
            z *= u(0x94D049BB133111EB)
            z ^= z >> u(31)
            value = turn[at:to] | (z >> u(8))
            if at < coordinates:
                np.minimum.at(out, (z & u(coordinates - 1)).astype(np.intp).ravel(), value.ravel())
            else:
                np.minimum.at(out, last_bins[at:to] - coordinates, value.min(axis=1))
            at = to
            if out.max() != none:
                break
        return out

    return sketch


def make_shingler(words: int):
    """A function text -> sorted distinct 64-bit shingle hashes, A-Z lower-cased."""
    import numpy as np
    import xxhash

    u, digest = np.uint64, xxhash.xxh3_64_intdigest
    odd = [u(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    if not 1 <= words <= len(odd):
        raise ValueError(f"words: 1 to {len(odd)}")

    def shingles(text: str):
        tokens = text.encode().lower().split()
        n = len(tokens)
        w = np.fromiter(map(digest, tokens), dtype=u, count=n)
        if not n:
            return w
        k = min(words, n)
        h = np.zeros(n - k + 1, dtype=u)
        for i in range(k):
            h += w[i:n - k + 1 + i] * odd[i]
            h ^= h >> u(29)
            h *= u(0xBF58476D1CE4E5B9)
        h ^= h >> u(32)
        return np.unique(h)

    return shingles


def fingerprints(docs: DataFrame, *, doc_id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128-bit digest of the set), bands."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        u = np.uint64
        shingles, sketch = make_shingler(words), make_sketcher(bands * rows)
        place = np.arange(bands, dtype=u) * u(0x9E3779B97F4A7C15)
        for b in batches:
            sizes, digests, keys, counts = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t or "")
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                if len(h):
                    s = sketch(h).reshape(bands, rows)
                    k = place.copy()
                    for r in range(rows):
                        k ^= s[:, r]
                        k *= u(0xC2B2AE3D27D4EB4F)
                        k ^= k >> u(31)
                    keys.append(k.view(np.int64))
                counts.append(bands if len(h) else 0)
            pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def make_shingle_set(words: int):
    """A function text -> the set of its word shingles, A-Z lower-cased; the words themselves, no hashes."""

    def shingle_set(t):
        w = (t or "").encode().lower().split()
        return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else ({tuple(w)} if w else set())

    return shingle_set


def similar(x: set, y: set, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, *, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. ``texts``: id, t."""
    kind = texts.schema["id"].dataType.simpleString()
    first = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    second = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))

    def run(batches):
        import pyarrow as pa

        shingle_set, last, last_set = make_shingle_set(words), object(), set()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ta != last:
                    last, last_set = ta, shingle_set(ta)
                keep.append(similar(last_set, shingle_set(tb), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(second.hint("merge"), "b").join(first.hint("merge"), "a").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _links_between(members: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components of a candidate group, by their names, without a row for each pair.

    ``members``: grp, id, component, t. All but the members of a group's
    largest component are its queries. Queries and members are dealt to
    blocks; each pair of blocks is one task group, which keeps the links that join two components first.
    """
    kind = members.schema["id"].dataType.simpleString()
    size = F.octet_length("t").cast("bigint")
    sizes = members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("s"))
    main = sizes.groupBy("grp").agg(F.max_by(F.struct("component", "s"), F.struct("c", "component")).alias("top"), F.sum("s").alias("g"), F.count(F.lit(1)).alias("n")).where("n > 1")
    main = common.table(main, "group-sizes")
    if main.count() <= FEW_GROUPS:
        main = F.broadcast(main)  # a checked size; beyond it the groups are joined by a shuffle
    rows = members.join(main, "grp")
    m_blocks, q_blocks = F.ceil(F.col("g") / MEMBER_BYTES).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("g") - F.col("top.s")) / QUERY_BYTES).cast("int"))
    h = F.xxhash64("id")
    dealt = rows.select("grp", "id", "component", "t", F.col("top.component").alias("main"), m_blocks.alias("mb"), q_blocks.alias("qb"), F.pmod(h, m_blocks).cast("int").alias("mi"), F.pmod(h, q_blocks).cast("int").alias("qi"))
    as_member = dealt.select("grp", F.col("mi").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("query"), "id", "component", "t")
    as_query = dealt.where("component <> main").select("grp", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.col("qi").alias("q"), F.lit(True).alias("query"), "id", "component", "t")

    def compare(table):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        shingle_set = make_shingle_set(words)
        rows = list(zip(table.column("query").to_pylist(), table.column("id").to_pylist(), table.column("component").to_pylist(), map(shingle_set, table.column("t").to_pylist()), strict=True))
        others, asked = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        here, there = {r[1] for r in others}, {r[1] for r in asked}
        in_others, in_asked = Counter(s for r in others for s in r[3]), Counter(s for r in asked for s in r[3])
        n = np.array([len(r[3]) for r in others])
        # No pair can share more shingles than stand anywhere on the other side: an exact bound.
        most = np.array([sum(in_asked[s] > (r[1] in there) for s in r[3]) for r in others])
        up: dict = {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        a, b = [], []
        for _, i, c, x in asked:
            share = np.minimum(most, sum(in_others[s] > (i in here) for s in x))
            for k in np.flatnonzero((share > 0) & (100 * share >= percent * (len(x) + n - share))).tolist():
                _, j, d, y = others[k]
                if top(c) != top(d) and similar(x, y, percent):
                    up[top(c)] = top(d)
                    a.append(c)
                    b.append(d)
        t = table.schema.field("id").type
        return pa.table({"a": pa.array(a, t), "b": pa.array(b, t)})

    return as_member.unionByName(as_query).groupBy("grp", "m", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept."""
    checks = {"words": words, "percent": percent}
    prints = common.table(fingerprints(docs, doc_id=doc_id, text=text, words=words, bands=bands, rows=rows), "fingerprints")
    linkable = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.table(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = common.table(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("a"), F.max("rep").alias("z")).where("m > 1"), "buckets")
    of_two = shared.where("m = 2 AND a <> z").select("a", F.col("z").alias("b"))
    wide = banded.join(shared.where("m > 2").select("band", "a", "m"), "band")
    weight = wide.groupBy("rep").agg(F.sum("m").alias("weight"))
    wide = common.table(wide.select("band", "rep", "a").join(weight, "rep"), "wide-buckets")
    pivots = wide.groupBy("band").agg(F.max_by("rep", F.struct("weight", "rep")).alias("p"))
    to_pivot = wide.join(pivots, "band").where("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
    tried = common.table(of_two.unionByName(wide.where("rep <> a").select("a", F.col("rep").alias("b"))).unionByName(to_pivot).distinct(), "pairs")
    ids = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct()
    whole = docs.select(docs[doc_id].alias("id"), docs[text].alias("t"))
    texts = common.table(whole.join(ids.hint("merge"), "id", "left_semi"), "candidate-texts")
    links = common.table(verified(tried, texts, **checks), "links")
    found = common.table(components(links), "components")

    # The rest: candidate groups that still hold several components. What follows works on components, not on documents.
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    apart = (tried.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).where("a <> b"))
    groups = components(apart).select(F.col("node").alias("component"), F.col("component").alias("grp"))
    held = (ids.join(of("id"), "id", "left").select("id", F.coalesce("id_in", "id").alias("component")).join(groups, "component"))
    # Two single documents that were compared need no second look.
    split = held.groupBy("grp").agg(F.count(F.lit(1)).alias("g")).where("g > 2").select("grp")
    held = common.table(held.join(split, "grp"), "groups-apart")
    more = common.table(_links_between(held.join(texts.hint("merge"), "id"), **checks), "links")
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        alone = joined.join(found, "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
        found = common.table(found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(alone), "components")

    named = classes.select("d1", "d2", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("class"))
    of_doc = linkable.join(named, ["d1", "d2"]).groupBy("doc_id").agg(F.min("class").alias("class"))
    out = prints.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
