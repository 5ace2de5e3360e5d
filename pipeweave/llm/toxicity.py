"""Toxicity by misspelling-tolerant term search.

Terms are learned from labelled rows: a word is a term when the contexts that
hold it (its two neighbours, so that copies of one text count once) are far
likelier in toxic rows. The lexicon is a trie; a Levenshtein automaton is
intersected with it and determinised lazily, so a word is read once, letter by
letter, and most words die after a few letters. Each hit is scored in its
context window: other hits near it raise abuse, quotation marks or reporting
words lower it. A logistic model over these figures gives the score.

Only texts and the toxic label of training rows are inputs. The labelled rows
used are the ``max_labelled`` with the smallest hash of their id (a documented
bound of the fit); scoring covers every whole text.

Defined results: a null or empty text has no hits and gets the model's score
for that; repeated rows are scored alike; without labelled rows of both
classes nothing is fitted: the score is the smoothed share of toxic rows (0.5
without any), which says nothing of a text, and ``accepted`` keeps every row; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import worker_memory

MAX_LABELLED = 20_000
#: Distinct contexts that a term needs in toxic rows, and how much likelier they must be there.
MIN_CONTEXTS = 4
MIN_RATIO = 8.0
WINDOW = 6
#: Letters stripped from the ends of words, quotation marks, reporting words of four languages.
EDGE = ".,;:!?()[]{}<>|*#$%&\"'`‘’“”«»„"
QUOTES = "\"“”«»„"
REPORTING = ("said", "says", "quote", "quoted", "wrote", "called", "term", "word", "sagte", "zitat", "wort", "dit", "mot", "citation", "dijo", "palabra", "cita")


@dataclass
class Model:
    terms: dict[str, float]
    weights: list[float]
    prior: float


def make_matcher(terms: dict[str, float], edits: int = 1, long_term: int = 5):
    """A function word -> (term, edits) or None: trie x Levenshtein automaton.

    A state is a set of (trie node, edits so far). Terms shorter than
    ``long_term`` letters must match exactly.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[str | None] = [None]
    for term in terms:
        node = 0
        for ch in term:
            if ch not in children[node]:
                children[node][ch] = len(children)
                children.append({})
                ends.append(None)
            node = children[node][ch]
        ends[node] = term

    def closed(items: dict[int, int]) -> frozenset:
        """With letters of a term left out."""
        stack = list(items.items())
        while stack:
            node, e = stack.pop()
            if e < edits:
                for child in children[node].values():
                    if items.get(child, edits + 1) > e + 1:
                        items[child] = e + 1
                        stack.append((child, e + 1))
        return frozenset(items.items())

    number: dict[frozenset, int] = {}
    moves: list[dict[str, int]] = []
    states: list[frozenset] = []
    verdict: list[tuple[str, int] | None] = []

    def state(items: frozenset) -> int:
        if items not in number:
            best = None
            for node, e in items:
                term = ends[node]
                if term is not None and (e == 0 or len(term) >= long_term) and (best is None or (e, term) < (best[1], best[0])):
                    best = (term, e)
            number[items] = len(states)
            states.append(items)
            moves.append({})
            verdict.append(best)
        return number[items]

    def step(at: int, ch: str) -> int:
        items: dict[int, int] = {}
        for node, e in states[at]:
            child = children[node].get(ch)
            if child is not None and items.get(child, edits + 1) > e:
                items[child] = e
            if e < edits:
                if items.get(node, edits + 1) > e + 1:
                    items[node] = e + 1
                for c, other in children[node].items():
                    if c != ch and items.get(other, edits + 1) > e + 1:
                        items[other] = e + 1
        return state(closed(items))

    def start() -> None:
        number.clear()
        moves.clear()
        states.clear()
        verdict.clear()
        state(frozenset())
        state(closed({0: 0}))

    start()

    def match(word: str):
        if len(states) > 200_000:
            start()
        at = 1
        for ch in word:
            to = moves[at].get(ch)
            if to is None:
                to = moves[at][ch] = step(at, ch)
            at = to
            if at == 0:
                return None
        return verdict[at]

    return match


def make_features(terms: dict[str, float], window: int = WINDOW):
    """A function text -> figures of its hits in their context windows."""
    match = make_matcher(terms)
    edge, quotes, reporting = EDGE, set(QUOTES), set(REPORTING)
    limit = 300_000

    class Memo(dict):
        def __missing__(self, raw):
            found = match(raw.strip(edge))
            if len(self) > limit:
                self.clear()
            self[raw] = found
            return found

    look = Memo().__getitem__

    def figures(text: str) -> list[float]:
        words = text.lower().split()
        hits = [(i, h) for i, h in enumerate(map(look, words)) if h]
        if not hits:
            return [0.0] * 7
        exact = fuzzy = quoted = weight = 0.0
        near = best = 0.0
        for k, (i, (term, e)) in enumerate(hits):
            around = words[max(0, i - window):i + window + 1]
            marks = sum(w[0] in quotes or w[-1] in quotes for w in around)
            if marks >= 2 or any(w.strip(edge) in reporting for w in around):
                quoted += 1
            elif e:
                fuzzy += 1
            else:
                exact += 1
            weight += terms[term] / (1 + e)
            best = max(best, terms[term] / (1 + e))
            near += (k > 0 and i - hits[k - 1][0] <= window)
        n = len(words)
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(weight), best, math.log1p(near), 100.0 * len(hits) / n]

    return figures


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, train, max_labelled: int) -> DataFrame:
    """text and label of at most ``max_labelled`` training rows."""
    chosen = (labels.where(labels[label].isNotNull()).select(labels[doc_id].alias("label_id"), labels[label].cast("int").alias("y"))
              .withColumn("order_", F.xxhash64("label_id")))
    if train is not None:
        chosen = chosen.where(train("label_id"))
    chosen = chosen.orderBy("order_", "label_id").limit(max_labelled)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    # At most max_labelled ids: a proven bound.
    return rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train=None, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn terms and weights. ``train``: from a column name to a condition on training rows."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows, path = common.write_table(_labelled(docs, labels, doc_id, text, label, train, max_labelled), "toxic-train")
    totals = {int(r[0]): int(r[1]) for r in rows.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    prior = (pos + 1) / (pos + neg + 2)
    if not pos or not neg:
        common.remove(spark, path)
        return Model({}, [], prior)
    edge = EDGE

    def contexts(batches):
        """Distinct (word, neighbours) of toxic rows."""
        import pyarrow as pa
        import xxhash

        for b in batches:
            words, keys = [], []
            for t in b.column(0).to_pylist():
                ws = [w.strip(edge) for w in (t or "").lower().split()]
                for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
                    if len(w) > 2:
                        words.append(w)
                        keys.append(xxhash.xxh3_64_intdigest(f"{before} {after}".encode()) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(keys, pa.int64())], ["word", "context"])

    def tally(y: int) -> DataFrame:
        return rows.where(F.col("y") == y).select("text").mapInArrow(contexts, "word string, context bigint").distinct()

    toxic = tally(1).groupBy("word").agg(F.count(F.lit(1)).alias("p")).where(F.col("p") >= MIN_CONTEXTS)
    clean = tally(0).groupBy("word").agg(F.count(F.lit(1)).alias("q"))
    both = toxic.join(clean, "word", "left").fillna(0, ["q"])
    ratio = (F.col("p") / pos) / ((F.col("q") + 0.5) / neg)
    found = both.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy("word").collect()  # words of at most max_labelled rows
    terms = {r["word"]: min(6.0, math.log(r["ratio"])) for r in found}

    def figures(batches):
        import pyarrow as pa

        make = make_features(terms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([make(t or "") for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    sample = rows.select("text", "y").mapInArrow(figures, "x array<double>, y int").collect()
    common.remove(spark, path)
    return Model(terms, _logistic([r["x"] for r in sample], [r["y"] for r in sample]), prior)


def _logistic(xs: list[list[float]], ys: list[int], ridge: float = 1e-2, rounds: int = 30) -> list[float]:
    """Newton's method; the bias comes last."""
    import numpy as np

    x = np.column_stack([np.array(xs), np.ones(len(xs))])
    y = np.array(ys, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits of every whole text."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    terms, weights, prior = model.terms, model.weights, model.prior

    def run(batches):
        import pyarrow as pa

        figures = worker_memory(("toxicity", hash(frozenset(terms.items()))), lambda: make_features(terms))
        for b in batches:
            scores, hits = [], []
            for t in b.column(1).to_pylist():
                x = figures(t or "")
                z = sum(a * c for a, c in zip(x, weights)) + (weights[-1] if weights else 0.0)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if weights else prior)
                hits.append(round(math.expm1(x[0]) + math.expm1(x[1]) + math.expm1(x[2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int32())], ["doc_id", "score", "hits"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, score double, hits int")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``, or all rows without a fitted model; nothing is shuffled."""
    if not model.weights:
        return docs
    common.small_batches(docs.sparkSession)
    place = docs.columns.index(text)
    terms, weights = model.terms, model.weights

    def run(batches):
        import pyarrow as pa

        figures = worker_memory(("toxicity", hash(frozenset(terms.items()))), lambda: make_features(terms))
        for b in batches:
            keep = []
            for t in b.column(place).to_pylist():
                x = figures(t or "")
                z = sum(a * c for a, c in zip(x, weights)) + weights[-1]
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < limit)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
