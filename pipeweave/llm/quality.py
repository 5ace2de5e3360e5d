"""Quality rules: a linear-chain conditional random field labels lines.

Each line has yes/no figures of its form (length, symbols, repeated words,
capitals, closing mark, earlier line alike). A conditional random field over
the lines of a document, with the states content and boilerplate, is fitted by
gradient ascent on its log-likelihood (forward and backward passes over all
sequences at once). Line labels for the fit are weak and mixed within a
document: lines that a document repeats, and lines that stand between
different neighbours in three or more places of the sample, are boilerplate,
whatever the document's label; in a document of poor quality so are lines with
marks of junk (symbols, capitals, few distinct words); other lines of a good
document are content. All else is left open: the likelihood sums over both
states there. Viterbi decoding then marks each line, and the share of a
document's words that lie in content lines decides whether it is kept. The
limit of the share is the one that parts the labelled documents best.

The labelled documents used are the ``max_labelled`` with the smallest hash of
their id, and of their segments of 64 lines the ``max_segments`` with the smallest hash
(documented bounds of the fit); decoding covers every whole text. Repeated
words are counted by 64-bit hashes of their windows.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged each for itself; without labelled rows of both
classes the base rule alone decides; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WS

MAX_LABELLED = 4_000
MAX_SEGMENTS = 3_000
SYMBOLS = "#*$%&|<>"
#: Lines of one training sequence; longer documents are several.
SEGMENT = 64
MIN_WORDS = 50
REPEAT_PERCENT = 50
FIGURES = 17
#: Figures that mark junk: many symbols, marks, capitals, few distinct words.
JUNK = 1 << 6 | 1 << 7 | 1 << 9 | 1 << 10 | 1 << 11 | 1 << 12 | 1 << 13
#: Places between different neighbours that make a line of the sample boilerplate.
SHARED = 3
#: Weak labels of a line: either state, or open.
OPEN = 2


@dataclass
class Model:
    emission: list[float]  # of content against boilerplate, for each figure
    start: list[float]
    move: list[list[float]]
    limit: float


def line_figures(text: str) -> tuple[list[int], list[int]]:
    """For each line its figures as bits, and its number of words."""
    out, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        sizes.append(n)
        if not n:
            out.append(1)
            continue
        chars = len(line)
        symbols = sum(map(line.count, SYMBOLS))
        distinct = len(set(words)) / n
        letters = line.upper()
        upper = sum(map(str.isupper, words)) / n
        digits = sum(w[0].isdigit() for w in words) / n
        bits = 2
        bits |= (n <= 2) << 2 | (3 <= n <= 5) << 3 | (n > 15) << 4
        bits |= (symbols > 0) << 5 | (symbols > 0.02 * chars) << 6 | (symbols > 0.08 * chars) << 7
        bits |= ("|" in line) << 8 | ("!!" in line) << 9
        bits |= (upper > 0.5 and letters == line) << 10 | (upper > 0.3) << 11
        bits |= (n > 4 and distinct < 0.3) << 12 | (n > 4 and distinct < 0.6) << 13
        bits |= (words[-1][-1] not in ".!?…\"”»") << 14
        bits |= (line in seen) << 15 | (digits > 0.3) << 16
        seen.add(line)
        out.append(bits)
    return out, sizes


def weak_labels(text: str, bits: list[int], good: bool) -> tuple[list[int], list[int], list[int]]:
    """For each line its weak label, and hashes of its key and of its neighbours' keys."""
    from collections import Counter

    import xxhash

    digest = xxhash.xxh3_64_intdigest
    keys = [digest(" ".join(line.split()).lower().encode()) - (1 << 63) for line in text.split("\n")]
    times = Counter(keys)
    places = [digest(f"{a} {b}".encode()) - (1 << 63) for a, b in zip([0, *keys], [*keys[1:], 0])]
    out = [OPEN if b & 1 else 0 if times[k] > 1 or not good and b & JUNK else 1 if good else OPEN for b, k in zip(bits, keys, strict=True)]
    return out, keys, places


def _chain(score, move, here):
    """Log partition, marginals of states and of pairs of neighbours, by forward and backward passes."""
    import numpy as np

    rows, width, _ = score.shape
    alpha, beta = np.zeros((rows, width, 2)), np.zeros((rows, width, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, width):
        z = alpha[:, t - 1, :, None] + move
        alpha[:, t] = np.where(here[:, t, None] > 0, np.logaddexp(z[:, 0], z[:, 1]) + score[:, t], alpha[:, t - 1])
    for t in range(width - 2, -1, -1):
        z = move + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(here[:, t + 1, None] > 0, np.logaddexp(z[:, :, 0], z[:, :, 1]), 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
    one = np.exp(alpha + beta - total) * here[:, :, None]
    two = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[..., None]) * here[:, 1:, None, None]
    return one, two


def fit_crf(sequences: list[list[int]], labels: list[list[int]], weights: list[float], rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3):
    """emission, start, move of the sequences of figure bits; ``labels``: the state of each line, or OPEN."""
    import numpy as np

    groups: dict[int, list[int]] = {}
    for r, s in enumerate(sequences):
        if s:
            groups.setdefault(max(2, 1 << (len(s) - 1).bit_length()), []).append(r)
    packed = []
    for width, own in groups.items():
        bits, here, barred = np.zeros((len(own), width), dtype=np.int64), np.zeros((len(own), width)), np.zeros((len(own), width, 2))
        for k, r in enumerate(own):
            n = len(sequences[r])
            bits[k, :n], here[k, :n] = sequences[r], 1
            y = np.array(labels[r])
            barred[k, :n, 0], barred[k, :n, 1] = -60.0 * (y == 1), -60.0 * (y == 0)
        w = np.array([weights[r] for r in own]) / sum(weights[r] * len(sequences[r]) for r in range(len(sequences)))
        packed.append(((bits[:, :, None] >> np.arange(FIGURES) & 1).astype(float), here, barred, w))
    theta = np.zeros(FIGURES + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, start, move = theta[:FIGURES], theta[FIGURES:FIGURES + 2], theta[FIGURES + 2:].reshape(2, 2)
        grad = -ridge * theta
        for x, here, barred, weight in packed:
            score = np.stack([np.zeros(here.shape), x @ w], axis=2)
            score[:, 0] += start
            free, free_pairs = _chain(score, move, here)
            told, told_pairs = _chain(score + barred, move, here)
            diff = (told - free) * weight[:, None, None]
            grad[:FIGURES] += np.einsum("rt,rtf->f", diff[:, :, 1], x)
            grad[FIGURES:FIGURES + 2] += diff[:, 0].sum(axis=0)
            grad[FIGURES + 2:] += ((told_pairs - free_pairs) * weight[:, None, None, None]).sum(axis=(0, 1)).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:FIGURES].tolist(), theta[FIGURES:FIGURES + 2].tolist(), theta[FIGURES + 2:].reshape(2, 2).tolist()


def make_decoder(emission: list[float], start: list[float], move: list[list[float]]):
    """A function figure bits -> 1 (content) or 0 for each line: the best path."""
    known: dict[int, float] = {}
    (m00, m01), (m10, m11) = move

    def decode(bits: list[int]) -> list[int]:
        scores = []
        for b in bits:
            s = known.get(b)
            if s is None:
                s = known[b] = sum(w for i, w in enumerate(emission) if b >> i & 1)
            scores.append(s)
        a0, a1 = start[0], start[1] + scores[0]
        back = []
        for s in scores[1:]:
            f0, f1 = a0 + m00 >= a1 + m10, a0 + m01 > a1 + m11
            back.append((0 if f0 else 1, 0 if f1 else 1))
            a0, a1 = (a0 + m00 if f0 else a1 + m10), (a0 + m01 if f1 else a1 + m11) + s
        at = 1 if a1 >= a0 else 0
        path = [at]
        for b in reversed(back):
            at = b[at]
            path.append(at)
        return path[::-1]

    return decode


def share(path: list[int], sizes: list[int]) -> float:
    """Of the words, those in content lines."""
    return sum(n for n, c in zip(sizes, path, strict=True) if c) / max(1, sum(sizes))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, max_segments: int = MAX_SEGMENTS) -> Model | None:
    common.small_batches(docs.sparkSession)
    chosen = (labels.where(labels[label].isNotNull()).select(labels[doc_id].alias("label_id"), labels[label].cast("int").alias("y"))
              .withColumn("order_", F.xxhash64("label_id")).orderBy("order_", "label_id").limit(max_labelled))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    # At most max_labelled ids: a proven bound.
    sample, path = common.write_table(rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).select(F.coalesce("text", F.lit("")).alias("text"), "y"), "quality-sample")

    def segments(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits, _ = line_figures(t)
                told, keys, places = weak_labels(t, bits, bool(y))
                for i in range(0, len(bits), SEGMENT):
                    out.append((bits[i:i + SEGMENT], told[i:i + SEGMENT], keys[i:i + SEGMENT], places[i:i + SEGMENT], y))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["bits", "told", "keys", "places", "y"])

    parts = sample.mapInArrow(segments, "bits array<int>, told array<int>, keys array<bigint>, places array<bigint>, y int")
    parts = parts.orderBy(F.xxhash64("keys", "places"), "y").limit(max_segments).collect()
    if len({r["y"] for r in parts}) < 2:
        common.remove(docs.sparkSession, path)
        return None
    places: dict[int, set[int]] = {}
    for r in parts:
        for k, p in zip(r["keys"], r["places"], strict=True):
            places.setdefault(k, set()).add(p)
    told = [[0 if t == 1 and len(places[k]) >= SHARED else t for t, k in zip(r["told"], r["keys"], strict=True)] for r in parts]
    count = [sum(r["y"] == y for r in parts) for y in (0, 1)]
    # Good and poor documents weigh the same, and a segment of few lines as much as one of many.
    emission, start, move = fit_crf([r["bits"] for r in parts], told, [0.5 / max(1, count[r["y"]]) / len(r["bits"]) for r in parts])

    def shares(batches):
        import pyarrow as pa

        decode = make_decoder(emission, start, move)
        for b in batches:
            found = [line_figures(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([share(decode(f), s) for f, s in found], pa.float64()), pa.array([sum(s) for _, s in found], pa.int64()), b.column(1)], ["share", "n", "y"])

    judged = [(r["share"], r["y"]) for r in sample.mapInArrow(shares, "share double, n bigint, y int").where(F.col("n") >= MIN_WORDS).collect()]
    common.remove(docs.sparkSession, path)
    good, bad = max(1, sum(y for _, y in judged)), max(1, sum(1 - y for _, y in judged))
    # A clean document lost costs more than one of poor quality kept.
    best = max((5 * sum(y for s, y in judged if s >= k / 40) / good + sum(1 - y for s, y in judged if s < k / 40) / bad, -abs(k - 20), k) for k in range(1, 40))
    return Model(emission, start, move, best[2] / 40)


def judge(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base figures, content_share, n_content_lines, base_failed, kept."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = (model.emission, model.start, model.move, model.limit) if model else None

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        u, digest = np.uint64, xxhash.xxh3_64_intdigest
        decode = make_decoder(*parts[:3]) if parts else None

        def repeated(words: list[bytes]) -> int:
            n = len(words)
            if n < 4:
                return 0
            w = np.fromiter(map(digest, words), dtype=u, count=n)
            h = (w[:-2] * u(0x9E3779B97F4A7C15)) ^ (w[:-2] >> u(29))
            h = (h + w[1:-1]) * u(0xC2B2AE3D27D4EB4F)
            h ^= h >> u(31)
            h = (h + w[2:]) * u(0x165667B19E3779F9)
            h ^= h >> u(32)
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            if not same.any():
                return 0
            again = np.zeros(len(h), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for i in range(3):
                covered[i:n - 2 + i] |= again
            return int(covered.sum())

        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                words = t.encode().split()
                n = len(words)
                seen: set[str] = set()
                dup = 0
                for line in t.split("\n"):
                    if line.strip(WS):
                        if line in seen:
                            dup += 1
                        else:
                            seen.add(line)
                rep = repeated(words)
                failed = n < MIN_WORDS or 100 * rep > REPEAT_PERCENT * n
                bits, sizes = line_figures(t)
                path = decode(bits) if decode else [1] * len(bits)
                content = share(path, sizes)
                rows.append((n, len(t) - sum(map(t.count, WS)), sum(map(t.count, SYMBOLS)), dup, rep, content, sum(path), failed, not failed and (parts is None or content >= parts[3])))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))],
                                             ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "n_content_lines", "base_failed", "kept"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_share double, n_content_lines bigint, base_failed boolean, kept boolean")
