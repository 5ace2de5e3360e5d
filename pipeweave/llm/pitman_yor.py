"""Language-model scoring by a hierarchical Pitman-Yor model.

Dishes are words; restaurants are contexts. The context of a token is the word
before it (a start mark before the first): each such word has a restaurant of
its own, and all of them share one parent, whose base is uniform over the
vocabulary and one unknown word. Restaurants, dishes and their tables grow
with the corpus.

Training counts (context, word) pairs; each is a dish of its context's
restaurant. A dish that one customer eats has one table there whatever is
drawn, so pairs that occur once are never reseated, but they are dishes like
the others: they hold their table, their customer in the parent and their own
share of a prediction. Gibbs sweeps reseat the customers of every other
pair by the Chinese-restaurant process, given the tables of all other dishes
and the parent's probability of the word; each new table sends a customer to
the parent, whose dishes are reseated in turn. The wait for the next new table
is beta-geometric, so all customers up to it are seated at once, with the
law of seating them one by one and at any count. Discounts come from the
corpus' counts of ones and twos. After ``burn`` sweeps the seats of
``samples`` sweeps are averaged: with the mean tables t of a pair and T of a
context and the mean probability of the parent,

    p(word | context) = (n - d t) / (s + N) + (s + d T) / (s + N) * p(word).

It sums to one over the vocabulary and the unknown word.

Pairs lie in buckets and words in homes, both by their hash. In a sweep a
bucket sends each home the new tables of the words it holds, summed, and gets
back the words' seats in the parent and their tables as contexts. All are
sorted by hash and draws are seeded by bucket, so equal corpora in equally many
buckets have equal models however rows are dealt.

Scoring: log p splits into a part of the word, a part of the context word and
a part of the pair, 0 where the pair was never seen. Blocks of texts ask
buckets and homes for their distinct words and pairs and keep which texts
hold each; answers go back to the block and are added up there. So all
rows sent are bounded by the blocks' words and pairs, whatever the number of
buckets. No group is held whole: a word of a third of all tokens is one row of
its home, and the number of buckets follows the corpus.

Defined results: a null or empty text is the end token alone; rows with a null
id are scored like any other; repeated rows are counted and scored each for
itself; with no training rows every probability is 1 and each score 0; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import gc
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_hashes import make_hasher

#: Keys of the start mark and the end token; words have odd hashes, pairs even ones.
START, END = 1, 3
STRENGTHS = (10.0, 2.0)
BURN, SAMPLES = 1, 2
#: Tokens of a block of texts whose pairs are found at once.
BLOCK_TOKENS = 3 << 18
#: Characters of the corpus for each bucket.
BUCKET_CHARS = 12_000_000
#: Texts of a block, so that 16 bits name one.
BLOCK_TEXTS = 60_000
#: The same for each home of words.
SCORE_CHARS = 96_000_000
#: Buckets of a small corpus, if there are as many partitions.
LEAST = 64
#: Shares of the texts that are scored and of the buckets that are predicted, and of the buckets that are counted, one after the other, so that the messages of one are on disk at a time.
SHARES, COUNTED = 5, 2
#: Rows of an Arrow batch that go to Python where a row is a message of a block, or may be the state of a bucket or home.
MESSAGES, STATES = 16, 4
#: Kinds of rows: what a bucket or home holds, pairs that occur once, and messages between buckets and homes.
STATE, ONCE, ASK, ASK_ONCE, ANSWER, ANSWER_ONCE = range(6)
ROW = "place int, kind int, origin bigint, packed binary, stats array<bigint>"
#: Formats of packed arrays.
FORMS = ("u1", "<u2", "<u4", "<u8", "<f4", "<f8")
#: Parquet pages and row groups are cut by bytes after few rows, where rows hold arrays.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.block.size": str(16 << 20)}


def make_tokens():
    """A function from texts to (tokens, contexts, text of each token): words, then one end."""
    import numpy as np

    words = make_hasher()

    def tokens(texts: list[str | None]):
        h, owner = words([(t or "").encode() for t in texts])
        n = len(texts)
        each = np.bincount(owner, minlength=n)
        ends = np.cumsum(each + 1) - 1
        token = np.full(len(h) + n, END, dtype=np.uint64)
        inside = np.ones(len(token), dtype=bool)
        inside[ends] = False
        token[inside] = h
        context = np.concatenate([[np.uint64(START)], token[:-1]])
        context[ends - each] = START
        return token, context, np.repeat(np.arange(n), each + 1)

    return tokens


def pair_key(context, word):
    """An even 64-bit hash of each pair."""
    import numpy as np

    u = np.uint64
    z = context * u(0x9E3779B97F4A7C15) + word
    z ^= z >> u(32)
    z *= u(0xC2B2AE3D27D4EB4F)
    z ^= z >> u(29)
    z *= u(0x94D049BB133111EB)
    z ^= z >> u(32)
    return z & ~u(1)


def bucket_of(key, buckets: int):
    """The bucket of each hash by its high bits, so that hashes in order are buckets in order."""
    import numpy as np

    return ((key >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)


def seat(c, a, d, rng):
    """Tables of ``c`` customers that eat one dish, with weight ``a`` for a new table.

    With i customers at t tables the wait for the next table has the law of a
    geometric wait whose chance is drawn from Beta(a, i - d t).
    """
    import numpy as np

    c = np.asarray(c, dtype=np.int64)
    t = (c > 0).astype(np.int64)
    # The second of two customers: one draw, with the mean of that chance.
    two = np.flatnonzero(c == 2)
    t[two] += rng.random(len(two)) < a[two] / (a[two] + 1 - d)
    live, i = np.flatnonzero(c > 2), np.ones(len(c), dtype=np.int64)
    while len(live):
        chance = np.maximum(rng.beta(a[live], i[live] - d * t[live]), 1e-15)
        i[live] += np.minimum(rng.geometric(chance), c[live])
        live = live[i[live] <= c[live]]
        t[live] += 1
        live = live[i[live] < c[live]]
    return t


def _blocks(batches, column: int, limit: int):
    """Texts of whole batches, tokenised, in blocks of about ``limit`` tokens: (batches' rows, tokens, contexts, texts)."""
    import numpy as np

    tokens = make_tokens()
    held, size, first = [], 0, 0
    for b in batches:
        texts = b.column(column).to_pylist()
        at = 0
        while at < len(texts):
            # A few texts at a time, so that a batch of long texts is several blocks.
            to, chars = at, 0
            while to < len(texts) and (to == at or chars < 4 * limit):
                chars += len(texts[to] or "") + 1
                to += 1
            w, u, o = tokens(texts[at:to])
            held.append((b.slice(at, to - at), w, u, o + first))
            first += to - at
            size += len(w)
            at = to
            if size >= limit or first >= BLOCK_TEXTS - common.BATCH_ROWS:
                yield [x[0] for x in held], *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
                held, size, first = [], 0, 0
    if held:
        yield [x[0] for x in held], *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3))


def _counted(*columns):
    """Distinct rows of sorted columns: positions of the first of each, and how many."""
    import numpy as np

    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(columns[0])))


def _buckets(docs: DataFrame, text: str) -> tuple[int, int]:
    """How many buckets of pairs and homes of words: both follow the corpus."""
    whole = int(docs.agg(F.sum(F.length(text))).first()[0] or 0)
    least = min(common.partitions(docs.sparkSession), LEAST)
    return max(least, whole // BUCKET_CHARS), max(least, whole // SCORE_CHARS)


class PitmanYor:
    """The fitted model: sorted arrays of pairs by bucket and of words by home, and its scalars.

    ``table`` lists them: lp is log10 of a word's probability in the parent against the unknown word's, or of what a pair adds;
    back: log10 of the share of a word's own restaurant that is the parent's.
    """

    def __init__(self, packed: DataFrame, buckets: int, homes: int, n_tokens: int, vocabulary: int, unknown: float, discounts: tuple[float, float]):
        self.packed, self.buckets, self.homes = packed, buckets, homes
        self.n_tokens, self.vocabulary, self.unknown, self.discounts = n_tokens, vocabulary, unknown, discounts
        self.table = _listed(packed, buckets)


def pack(*arrays) -> bytes:
    """Arrays as bytes; whole numbers (none is negative) in the fewest bytes that hold them."""
    import numpy as np

    parts = []
    for a in arrays:
        kind = FORMS.index("<f4" if a.dtype == np.float32 else "<f8")
        if a.dtype.kind in "iu":
            kind = 0 if not len(a) else int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], int(a.max()), "right"))
        parts += [bytes([kind]), len(a).to_bytes(8, "little"), a.astype(FORMS[kind], copy=False).tobytes()]
    return b"".join(parts)


def unpack(packed: bytes) -> list:
    import numpy as np

    out, at = [], 0
    while at < len(packed):
        form, size = np.dtype(FORMS[packed[at]]), int.from_bytes(packed[at + 1:at + 9], "little")
        out.append(np.frombuffer(packed, dtype=form, count=size, offset=at + 9))
        at += 9 + size * form.itemsize
    return out


def _batch(rows: list[tuple]):
    """Rows (place, kind, origin, packed, stats) as an Arrow batch."""
    import pyarrow as pa

    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["place", "kind", "origin", "packed", "stats"])


def _cut(ids, columns, kind: int, origin: int, homes: int) -> list[tuple]:
    """Sorted ids and their columns as one message to each home."""
    at, size = _counted(bucket_of(ids, homes))
    places = bucket_of(ids[at], homes).tolist()
    return [(h, kind, origin, pack(ids[a:a + k], *(c[a:a + k] for c in columns)), None) for h, a, k in zip(places, at.tolist(), size.tolist(), strict=True)]


def _by_place(rows: DataFrame, run) -> DataFrame:
    """``run(place, rows (kind, origin, arrays))`` over each place, rows in order of kind and origin."""

    def each(batches):
        held, at = [], None
        for b in batches:
            for place, kind, origin, packed in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if place != at and held:
                    yield from run(at, held)
                    held = []
                at = place
                held.append((kind, origin, unpack(packed)))
        if held:
            yield from run(at, held)

    n = common.partitions(rows.sparkSession)
    return rows.select("place", "kind", "origin", "packed").repartition(n, "place").sortWithinPartitions("place", "kind", "origin").mapInArrow(each, ROW)


def _written(df: DataFrame, label: str, batch: int) -> tuple[DataFrame, str]:
    """Write rows that hold whole arrays: few to an Arrow batch, and pages are cut by their bytes."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        return common.write_table(df, label, **WIDE)
    finally:
        spark.conf.set(key, rows)


def _of(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select("place", "kind", "origin", "packed")


def _stats(rows: DataFrame, n: int) -> list[int]:
    return [int(x or 0) for x in rows.where("kind = 0").agg(*(F.sum(F.col("stats")[k]) for k in range(n))).first()]


def count_pairs(docs: DataFrame, text: str, buckets: int, share: int = 0, shares: int = 1) -> DataFrame:
    """Every distinct pair of the corpus, in the bucket of its hash, each with one table: the state before the first sweep.

    A bucket gives its pairs that occur twice or more (STATE) and those that occur once (ONCE): the words of either, and
    pairs as places in them. Of the buckets only those of a share are counted.
    """

    def send(batches):
        import numpy as np

        for _, w, u, _ in _blocks(batches, 0, BLOCK_TOKENS):
            key = pair_key(u, w)
            mine = np.flatnonzero(bucket_of(key, buckets) % shares == share)
            order = np.argsort(key[mine])
            order = mine[order]
            first, n = _counted(key[order])
            order = order[first]
            u, w, bucket = u[order], w[order], bucket_of(key[order], buckets)
            at, size = _counted(bucket)
            yield _batch([(int(bucket[a]), 0, 0, pack(u[a:a + k], w[a:a + k], n[a:a + k]), None) for a, k in zip(at.tolist(), size.tolist(), strict=True)])

    def settle(bucket, held):
        import numpy as np

        u, w, n = (np.concatenate([x[k] for _, _, x in held]) for k in range(3))
        held.clear()
        key = pair_key(u, w)
        order = np.argsort(key)
        first, _ = _counted(key[order])
        del key
        n = np.add.reduceat(n[order].astype(np.int64), first)
        order = order[first]
        u, w = u[order], w[order]
        for some, kind in ((n > 1, STATE), (n == 1, ONCE)):
            ids, number = np.unique(np.concatenate([u[some], w[some]]), return_inverse=True)
            m = n[some]
            iu, iw = number[:len(m)], number[len(m):]
            if kind == STATE:
                yield _batch([(bucket, STATE, 0, pack(ids, iu, iw, m, np.ones(len(m), np.int64), np.zeros(len(m), np.int64)), [int((m == 2).sum())])])
            else:
                # In order of the context, which is then a count for each word.
                yield _batch([(bucket, ONCE, 0, pack(ids, np.bincount(iu, minlength=len(ids)), iw[np.argsort(iu, kind="stable")]), None)])

    sent = docs.select(docs[text].alias("text")).mapInArrow(send, ROW)
    return _by_place(sent, settle)


def _asks(states: DataFrame, homes: int, counted: bool) -> DataFrame:
    """What buckets ask each home: their words there; ``counted``: with what their pairs add to these.

    For pairs that occur once tables and tokens are one number; for the others tables come first, then tokens.
    """

    def run(batches):
        import numpy as np

        for b in batches:
            for bucket, kind, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids, *x = unpack(packed)
                if not len(ids):
                    continue
                each = lambda i, of=None, k=len(ids): np.bincount(i, weights=of, minlength=k).astype(np.int64)
                columns = ()
                if counted:
                    columns = (each(x[1]), each(x[0]), each(x[1], x[2]), each(x[0], x[2])) if kind == STATE else (each(x[1]), x[0])
                yield _batch(_cut(ids, columns, ASK if kind == STATE else ASK_ONCE, bucket, homes))

    return states.select("place", "kind", "packed").mapInArrow(run, ROW).select("place", "kind", "origin", "packed")


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


class _Root:
    """Scalars of the parent restaurant: customers and tables."""

    def __init__(self, customers: int, tables: int, vocabulary: int, d: float):
        self.d, self.new = d, (STRENGTHS[0] + d * tables) / (vocabulary + 1)
        self.all = STRENGTHS[0] + customers
        self.unknown = self.new / self.all

    def p(self, c, t):
        """The probability of dishes with c customers at t tables."""
        return (c - self.d * t + self.new) / self.all


def _first_words(home, held):
    """A home's words as all buckets see them: tokens, customers from pairs that occur once, customers and tables as a context."""
    import numpy as np

    names = np.unique(np.concatenate([x[0] for _, _, x in held]))
    n, once, cu, su, c0, tu = (np.zeros(len(names), dtype=np.int64) for _ in range(6))
    for kind, _, x in held:
        i = np.searchsorted(names, x[0])
        c0[i] += x[1]
        tu[i] += x[2]
        n[i] += x[3] if kind == ASK else x[1]
        cu[i] += x[4] if kind == ASK else x[2]
        if kind == ASK_ONCE:
            once[i] += x[1]
            su[i] += x[2]
    t0 = np.minimum(c0, 1)
    stats = [(n > 0).sum(), n.sum(), su.sum(), (c0 == 1).sum(), (c0 == 2).sum(), c0.sum(), t0.sum()]
    yield _batch([(home, STATE, 0, pack(names, n, once, cu, su, np.zeros(len(names)), c0, t0, tu), [int(x) for x in stats])])
    for kind, bucket, x in held:
        if kind == ASK:
            i = np.searchsorted(names, x[0])
            yield _batch([(bucket, ANSWER, home, pack(c0[i], t0[i], tu[i]), None)])


def _reseat_words(root: _Root, add: bool, means: int, seed: list[int]):
    """Reseat the parent's dishes. ``add``: the state before is a sample, its probabilities go to ``psum``.

    ``means``: after the last sweep; buckets sent the tables of contexts summed over so many samples.
    """

    def run(home, held):
        import numpy as np

        names, n, once, cu, su, psum, c0, t0, _ = held[0][2]
        if add:
            psum = psum + root.p(c0.astype(float), t0)
        c0, tu = once.astype(np.int64), np.zeros(len(names), dtype=np.int64)
        for _, _, x in held[1:]:
            i = np.searchsorted(names, x[0])
            c0[i] += x[1]
            tu[i] += x[2]
        tu = su + tu / means if means else su + tu
        t0 = seat(c0, np.full(len(c0), root.new), root.d, np.random.default_rng([*seed, home, 1]))
        yield _batch([(home, STATE, 0, pack(names, n, once, cu, su, psum, c0, t0, tu), [int(c0.sum()), int(t0.sum())])])
        for _, bucket, x in held[1:] if not means else ():
            i = np.searchsorted(names, x[0])
            yield _batch([(bucket, ANSWER, home, pack(c0[i], t0[i], tu[i]), None)])

    return run


def _reseat_pairs(root: _Root, d: float, sample: bool, last: bool, seed: list[int], homes: int):
    """Reseat the pairs of a bucket that occur twice or more, given the parent and the tables of their contexts."""

    def run(bucket, held):
        import numpy as np

        ids, iu, iw, n, t, ts = held[0][2]
        if not len(ids):
            yield _batch([(bucket, STATE, 0, pack(ids, iu, iw, n, t, ts), None)])
            return
        # Homes are in order of the hash, so their answers are in order of the ids.
        c0, t0, tu = (np.concatenate([x[k] for _, _, x in held[1:]]).astype(float) for k in range(3))
        a = (STRENGTHS[1] + d * (tu[iu] - t)) * root.p(c0, t0)[iw]
        t = seat(n, a, d, np.random.default_rng([*seed, bucket, 0]))
        ts = ts + t if sample else ts
        yield _batch([(bucket, STATE, 0, pack(ids, iu, iw, n, t, ts), None)])
        each = lambda i, of: np.bincount(i, weights=of, minlength=len(ids)).astype(np.int64)
        yield _batch(_cut(ids, (each(iw, t), each(iu, ts if last else t)), ASK, bucket, homes))

    return run


def _predicted(root: _Root, d: float, samples: int):
    """For the words that buckets ask for: the parent's mean probability, and the parent's share in the word's own restaurant times its room."""

    def run(home, held):
        import numpy as np

        names, _, _, _, _, psum, c0, t0, tu = held[0][2]
        p0, share = ((psum + root.p(c0.astype(float), t0)) / samples).astype(np.float32), (STRENGTHS[1] + d * tu).astype(np.float32)
        for kind, bucket, x in held[1:]:
            i = np.searchsorted(names, x[0])
            yield _batch([(bucket, ANSWER if kind == ASK else ANSWER_ONCE, home, pack(p0[i], share[i]), None)])

    return run


def _pair_gains(d: float, samples: int):
    """What each pair adds to the log10 of the parent's share, in order of the pairs' hashes."""

    def run(bucket, held):
        import numpy as np

        keys, gains = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for kind, answer in ((STATE, ANSWER), (ONCE, ANSWER_ONCE)):
            ids, iu, iw, *state = next(x for k, _, x in held if k == kind)
            if not len(ids):
                continue
            p0, share = (np.concatenate([x[k] for q, _, x in held if q == answer]) for k in range(2))
            own = state[0] - d * (state[2] / samples) if state else 1.0 - d
            iu = iu if state else np.repeat(np.arange(len(ids)), iu)
            gains.append(np.log10(own / (share[iu].astype(float) * p0[iw]) + 1.0).astype(np.float32))
            keys.append(pair_key(ids[iu].astype(np.uint64), ids[iw].astype(np.uint64)))
        key, gain = (np.concatenate(x) for x in (keys, gains))
        order = np.argsort(key)
        yield _batch([(bucket, STATE, 0, pack(*_short(key[order]), gain[order]), None)])

    return run


def _short(key) -> tuple:
    """Sorted hashes: their high 16 bits with how often each occurs, and the low 48 bits."""
    import numpy as np

    first, n = _counted(key >> np.uint64(48))
    return key[first] >> np.uint64(48), n, np.frombuffer(_six(key), dtype=np.uint8)


def _long(high, n, six):
    import numpy as np

    return np.repeat(high.astype(np.uint64), n) << np.uint64(48) | _carried(six)


def _word_parts(root: _Root, d: float, samples: int, unknown: float, buckets: int):
    """lp, back and base of a home's words; the home's place comes after the buckets of pairs."""

    def run(batches):
        import numpy as np

        for b in batches:
            for home, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, n, _, cu, _, psum, c0, t0, tu = unpack(packed)
                p0 = (psum + root.p(c0.astype(float), t0)) / samples
                lp = np.where(n > 0, np.log10(p0) - math.log10(unknown), 0.0)
                back = np.log10((STRENGTHS[1] + d * tu) / (STRENGTHS[1] + cu.astype(float)))
                yield _batch([(buckets + home, STATE, 0, pack(*_short(names.astype(np.uint64)), lp, back, np.log10(n.astype(float) + 1.0)), None)])

    return run


def fit(docs: DataFrame, *, text: str = "text", burn: int = BURN, samples: int = SAMPLES, seed: int = 11) -> PitmanYor:
    spark = docs.sparkSession
    common.small_batches(spark)
    if samples < 1:
        raise ValueError("samples: 1 at least")
    buckets, homes = _buckets(docs, text)
    first, paths = [], []
    for share in range(COUNTED):
        df, path = _written(count_pairs(docs, text, buckets, share, COUNTED), "pairs", MESSAGES)
        first.append(df)
        paths.append(path)
        _free(spark)
    first = _union(first)
    pairs, pairs_path = first, None
    words, words_path = _written(_by_place(_asks(_of(first, STATE, ONCE), homes, True), _first_words), "words", STATES)
    _free(spark)
    vocabulary, n_tokens, ones, once0, twice0, customers, tables = _stats(words, 7)
    d1, d0 = _discount(ones, *_stats(first, 1)), _discount(once0, twice0)
    root, unknown = _Root(customers, tables, vocabulary, d0), 0.0
    for number in range(1, burn + samples + 1):
        sample, last = number > burn, number == burn + samples
        old = pairs_path
        asked = _of(pairs, STATE).unionByName(_of(words, ANSWER))
        pairs, pairs_path = _written(_by_place(asked, _reseat_pairs(root, d1, sample, last, [seed, number], homes)), "pairs", STATES)
        if old:
            common.remove(spark, old)
        old = words_path
        given = _of(words, STATE).unionByName(_of(pairs, ASK))
        words, words_path = _written(_by_place(given, _reseat_words(root, number > burn + 1, samples if last else 0, [seed, number])), "words", STATES)
        common.remove(spark, old)
        del asked, given
        _free(spark)
        root = _Root(*_stats(words, 2), vocabulary, d0)
        unknown += root.unknown / samples if sample else 0.0
    parts = [_written(_of(words, STATE).select("place", "packed").mapInArrow(_word_parts(root, d1, samples, unknown, buckets), ROW), "model", 1)[0]]
    for share in range(SHARES):
        mine = _of(pairs, STATE).unionByName(_of(first, ONCE)).where(F.col("place") % SHARES == share)
        answers = _by_place(_of(words, STATE).unionByName(_asks(mine, homes, False)), _predicted(root, d1, samples))
        parts.append(_written(_by_place(mine.unionByName(answers.drop("stats")), _pair_gains(d1, samples)), "model", STATES)[0])
        del mine, answers
        _free(spark)
    for path in (*paths, pairs_path, words_path):
        common.remove(spark, path)
    return PitmanYor(_union(parts), buckets, homes, n_tokens, vocabulary, unknown, (d0, d1))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _free(spark) -> None:
    """Shuffle files go when no plan claims them, and plans may be held by cycles of Python objects."""
    gc.collect()
    common.free_shuffles(spark)


def _listed(packed: DataFrame, buckets: int) -> DataFrame:
    """The model's packed rows as one row for each word and pair."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for place, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                high, n, six, *columns = unpack(packed)
                key = _long(high, n, six)
                columns = columns if place >= buckets else [columns[0], *(np.zeros(len(key)) for _ in range(2))]
                columns = [pa.array(x.astype(float)) for x in (*columns, columns[2] > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *columns], ["key", "lp", "back", "base", "known"])

    return packed.select("place", "packed").mapInArrow(run, "key bigint, lp double, back double, base double, known double")


#: The low bits of a hash that a message carries; the high ones name its place, whose keys are a bounded number.
CARRIED = (1 << 48) - 1


def pack_message(key, texts, at, n) -> bytes:
    """Keys (48 bits), how many entries each has, and the entries: a text of the message (16 bits), occurrences (8 bits; more are several entries)."""
    import numpy as np

    times = (n + 254) // 255
    if len(n) and times.max() > 1:
        last = np.cumsum(times) - 1
        owner = np.repeat(np.arange(len(texts)), texts)
        texts = np.bincount(owner, weights=times, minlength=len(texts))
        rest = n - 255 * (times - 1)
        at, n = np.repeat(at, times), np.full(int(times.sum()), 255)
        n[last] = rest
    six = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return b"".join([np.array([len(key), len(at)], dtype="<u4").tobytes(), six.tobytes(), texts.astype("<u4").tobytes(), at.astype("<u2").tobytes(), n.astype(np.uint8).tobytes()])


def unpack_message(packed: bytes):
    import numpy as np

    keys, entries = np.frombuffer(packed, dtype="<u4", count=2).tolist()
    key = np.zeros((keys, 8), dtype=np.uint8)
    key[:, :6] = np.frombuffer(packed, dtype=np.uint8, count=6 * keys, offset=8).reshape(-1, 6)
    at = 8 + 6 * keys
    texts = np.frombuffer(packed, dtype="<u4", count=keys, offset=at)
    at += 4 * keys
    return key.view("<u8").ravel(), texts, np.frombuffer(packed, dtype="<u2", count=entries, offset=at), np.frombuffer(packed, dtype=np.uint8, count=entries, offset=at + 2 * entries)


def _six(key) -> bytes:
    import numpy as np

    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _carried(six):
    """The low 48 bits of hashes from their bytes."""
    import numpy as np

    key = np.zeros((len(six) // 6, 8), dtype=np.uint8)
    key[:, :6] = six.reshape(-1, 6)
    return key.view("<u8").ravel()


def _ask(docs: DataFrame, doc_id: str, text: str, buckets: int, homes: int) -> DataFrame:
    """Blocks of texts: a row of each (place -1) keeps its ids and, for each key, the texts that hold it and how often;
    the others ask a place for the keys of the block that lie there."""
    form = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for held, w, u, o in _blocks(batches, 0, BLOCK_TOKENS):
            ids = pa.concat_arrays([b.column(1) for b in held])
            texts = np.arange(len(ids))
            words, pairs = np.concatenate([w, np.full(len(ids), START, dtype=np.uint64)]), pair_key(u, w)
            place, keys, size, at, n = [], [], [], [], []
            for key, owner, count, first in ((pairs, o, buckets, 0), (words, np.concatenate([o, texts]), homes, buckets)):
                # High bits name the place, so hashes in order are places in order; there the low bits are put in order.
                spot = bucket_of(key, count)
                order = np.argsort(spot.astype(np.uint64) << np.uint64(48) | key & np.uint64(CARRIED)) if count <= 1 << 16 else np.lexsort((key & np.uint64(CARRIED), spot))
                key, spot = key[order] & np.uint64(CARRIED), spot[order]
                each, many = _counted(spot, key)
                # A key and a text, in order.
                both = np.sort(np.repeat(np.arange(len(each)), many) << 32 | owner[order])
                start, times = _counted(both)
                place.append(spot[each] + first)
                keys.append(key[each])
                size.append(_counted(both[start] >> 32)[1])
                at.append(both[start] & 0xFFFFFFFF)
                n.append(times)
            place, keys = np.concatenate(place), np.concatenate(keys)
            kept = pack_message(keys, *(np.concatenate(x) for x in (size, at, n)))
            cut, many = _counted(place)
            asks = [_six(keys[a:a + k]) for a, k in zip(cut.tolist(), many.tolist(), strict=True)]
            rows = len(asks) + 1
            lists = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * rows], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *place[cut].tolist()], pa.int32()), pa.array([number] * rows, pa.int64()), pa.array([None, *asks], pa.binary()), pa.array([kept, *[None] * len(asks)], pa.binary()), lists],
                ["place", "origin", "packed", "kept", "ids"])
            number += 1

    return docs.select(docs[text].alias("text"), docs[doc_id].alias("doc_id")).mapInArrow(run, f"place int, origin bigint, packed binary, kept binary, ids array<{form}>")


def _answers(buckets: int):
    """The model's row of a place comes first, then the blocks that ask, each answered as it comes, in order of its keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, keys, columns = None, None, None
        for b in batches:
            out = []
            for place, kind, origin, packed in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if place != at:
                    at, keys = place, None
                if kind == 0:
                    _, _, six, *columns = unpack(packed)
                    keys = _carried(six)
                    order = np.argsort(keys)
                    keys = keys[order]
                    # A word is the context of the next one.
                    columns = [columns[0][order]] if place < buckets else [(columns[0] + columns[1])[order], columns[2][order]]
                    continue
                key = _carried(np.frombuffer(packed, dtype=np.uint8))
                found = [np.zeros(len(key), dtype=x) for x in ((np.float32,) if place < buckets else (float, float))]
                if keys is not None and len(keys):
                    i = np.searchsorted(keys, key)
                    i[i == len(keys)] = 0
                    ok = keys[i] == key
                    for f, c in zip(found, columns, strict=True):
                        f[ok] = c[i[ok]]
                out.append((place, origin, pack(*found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["place", "origin", "packed"])

    return run


def _added_up(buckets: int):
    """What a block keeps, then its answers in order of place: the sums of its texts."""

    def sums(ids, kept, answers):
        import numpy as np
        import pyarrow as pa

        key, texts, at, times = unpack_message(kept)
        pairs = np.concatenate([np.zeros(0), *(unpack(x)[0] for p, x in answers if p < buckets)])
        lp, base = (np.concatenate([unpack(x)[k] for p, x in answers if p >= buckets]) for k in range(2))
        first = len(pairs)  # words come after pairs
        lp, base = np.concatenate([pairs, lp]), np.concatenate([np.zeros(first), base])
        end = np.zeros(len(key), dtype=bool)
        end[first:] = key[first:] != START
        times = times.astype(float)
        total = [np.bincount(at, weights=times * np.repeat(x, texts), minlength=len(ids)) for x in (lp, base, base > 0, end)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in total)], ["doc_id", "lp", "base", "known", "n_tokens"])

    def run(batches):
        at, ids, kept, answers = None, None, None, []
        for b in batches:
            for r, (place, origin) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if origin != at:
                    if at is not None:
                        yield sums(ids, kept, answers)
                    at, answers = origin, []
                if place < 0:
                    ids, kept = b.column(4).slice(r, 1).flatten(), b.column(3)[r].as_py()
                else:
                    answers.append((place, b.column(2)[r].as_py()))
        if at is not None:
            yield sums(ids, kept, answers)

    return run


def score(docs: DataFrame, model: PitmanYor, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    n = common.partitions(spark)
    form = docs.schema[doc_id].dataType.simpleString()

    def summed(k: int) -> DataFrame:
        share = docs.where(F.pmod(F.coalesce(F.xxhash64(docs[text]), F.lit(0)), F.lit(SHARES)) == k)
        asked, path = common.write_table(_ask(share, doc_id, text, model.buckets, model.homes), "asked", **WIDE)
        messages = asked.where("place >= 0").select("place", F.lit(1).alias("kind"), "origin", "packed").unionByName(_of(model.packed, STATE))
        answers = messages.repartition(n, "place").sortWithinPartitions("place", "kind").mapInArrow(_answers(model.buckets), "place int, origin bigint, packed binary")
        both = answers.withColumns({"kept": F.lit(None).cast("binary"), "ids": F.lit(None).cast(f"array<{form}>")}).unionByName(asked.where("place < 0"))
        rows = both.repartition(n, "origin").sortWithinPartitions("origin", "place").mapInArrow(_added_up(model.buckets), f"doc_id {form}, lp double, base double, known double, n_tokens double")
        sums, _ = _written(rows, "sums", MESSAGES)
        common.remove(spark, path)
        return sums

    parts = []
    for k in range(SHARES):
        parts.append(summed(k))
        _free(spark)
    sums = _union(parts)
    spread, log_unknown = math.log10(model.n_tokens + model.vocabulary + 1), math.log10(model.unknown)
    return sums.select(
        "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("known").cast("bigint").alias("n_known"),
        (F.col("base") - F.col("n_tokens") * spread).alias("base_score"), F.least(F.lit(0.0), F.col("lp") + F.col("n_tokens") * log_unknown).alias("score"))
