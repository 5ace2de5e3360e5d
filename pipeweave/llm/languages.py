"""Language identification with a string kernel.

The kernel is the blended spectrum of presence: two texts are as near as the
number of distinct character runs of length 1 to ``LONGEST`` that both hold,
divided by the root of the product of their own numbers. Runs that no landmark
holds are no features. Landmarks are whole training texts, as many of each
language (Nyström): a text is known by its kernel values with them. One-versus-
rest ridge regression in the space that the landmarks span gives a weight for
each landmark and language, from sums over all sampled rows that tasks add up
for themselves.

Characters are classes: letters without case, the ``LETTERS`` commonest of the
sample apart and all others together; all that is no letter is one class. Runs
are found by walking a trie of the landmarks' runs as a table (run, class) ->
longer run, for all places of a text at once. A batch of texts becomes a
matrix of presences; its product with the landmarks' matrix gives the kernel
values and a further product the scores.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` distinct texts
of a language, chosen by hash, in at most ``LANGUAGES`` languages (the
commonest). Landmarks come from these, ``LANDMARKS`` in all, and the trie holds
at most ``RUNS`` runs (those that most landmarks hold), so the model's size is
bounded whatever the corpus. Predictions cover every row and whole texts.

Defined results: a text that is null or has no letter is ``und`` with a score
of 0, as is every text where nothing could be learned; with one language
learned, all other texts are of that language; very long texts are read in
parts that overlap by a run; repeated rows are judged each for itself; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import worker_memory

LONGEST = 3
LETTERS = 160
LANDMARKS = 240
PER_LANGUAGE = 1000
LANGUAGES = 200
RUNS = 30_000
RIDGE = 1e-3
#: Characters read at once.
PART = 1 << 18
#: Cells of a batch's presence matrix.
CELLS = 4_000_000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: The class of its own of each common letter, lower-case.
    letters: dict[str, int] = field(default_factory=dict)
    #: Trie: row 0 is the empty run, the last row is none; entry [run, class] is the run that is longer by it.
    trie: object = None
    #: Which run (row) each landmark (column) holds, packed bits, and the number of landmarks.
    held: object = None
    n_landmarks: int = 0
    #: Weights of landmarks (rows) for languages (columns).
    weights: object = None


def make_classes(letters: dict[str, int]):
    """A function from a text to its characters' classes: 0 no letter, 1 a letter without a class of its own."""
    import sys
    import unicodedata

    import numpy as np

    def build():
        table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = letters.get(chr(c).lower(), 1)
        return table

    table = worker_memory(("language-classes", tuple(sorted(letters.items()))), build)

    def run(text: str):
        return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    return run


def make_presence(letters: dict[str, int], trie):
    """A function from a text to (presence of each run, whether it has a letter)."""
    import numpy as np

    classes, none = make_classes(letters), len(trie) - 1

    def run(text: str):
        found, any_letter = np.zeros(none + 1, dtype=bool), False
        for at in range(0, max(len(text), 1), PART):
            c = classes(text[at:at + PART + LONGEST - 1])
            any_letter = any_letter or bool(c.any())
            runs = np.zeros(len(c), dtype=np.int32)
            for n in range(min(LONGEST, len(c))):
                runs = trie[runs[:len(c) - n], c[n:]]
                found[runs] = True
        found[none] = False
        return found, any_letter

    return run


def make_kernel(model: Model):
    """A function from texts to (kernel values with the landmarks, which texts have a letter), batch by batch."""
    import numpy as np

    presence = make_presence(model.letters, model.trie)
    held = np.unpackbits(model.held, axis=1, count=model.n_landmarks).astype(np.float32)
    held /= np.sqrt(np.maximum(held.sum(0), 1))
    rows = max(1, CELLS // len(held))

    def run(texts: list[str]):
        for at in range(0, len(texts), rows):
            each = [presence(t) for t in texts[at:at + rows]]
            x = np.array([p for p, _ in each], dtype=np.float32)
            yield (x @ held) / np.sqrt(np.maximum(x.sum(1), 1))[:, None], np.array([a for _, a in each])

    return run


def _sample(docs: DataFrame, doc_id: str, text: str, lang: str, train: Column | None, per_language: int) -> DataFrame:
    """lang, text, order_ of about ``per_language`` distinct texts of each language, by hash."""
    rows = docs.where(docs[lang].isNotNull() & docs[text].rlike(r"\p{L}"))
    if train is not None:
        rows = rows.where(train)
    rows = rows.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("order_"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("order_").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return rows.where("false")
    # A share of the hashes: copies of a text are taken or left together and then count once.
    least = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, per_language / max(1, r["n"])) * (1 << 30))))))
    chosen = rows.where(F.pmod("order_", F.lit(1 << 30)) < F.element_at(least, F.col("lang")))
    return chosen.groupBy("lang", "order_").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learn from a bounded sample of the rows where ``train`` holds and a language is given."""
    import numpy as np

    spark = docs.sparkSession
    common.small_batches(spark)
    sample, path = common.write_table(_sample(docs, doc_id, text, lang, train, per_language), "language-sample")
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        common.remove(spark, path)
        return Model([])
    letters = _letters(sample)
    held, runs, rows = _landmark_runs(sample, letters, languages, landmarks)
    model = Model(languages, letters, _trie(runs), None, rows)
    model.held = _held(held, model.trie, rows)
    model.weights = _weights(sample, model)
    common.remove(spark, path)
    return model


def _letters(sample: DataFrame) -> dict[str, int]:
    """Classes of the commonest letters of the sample; each task counts for itself."""

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(t.lower())
        some = [(c, k) for c, k in n.items() if c.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.string()), pa.array([k for _, k in some], pa.int64())], ["c", "n"])

    top = sample.select("text").mapInArrow(counted, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c").limit(LETTERS).collect()
    return {r["c"]: i + 2 for i, r in enumerate(top)}


def _landmark_runs(sample: DataFrame, letters: dict[str, int], languages: list[str], landmarks: int):
    """Runs of each landmark as sorted codes, all kept runs, and the number of landmarks."""
    import numpy as np

    each = max(1, landmarks // len(languages))
    base = LETTERS + 2

    def coded(batches):
        import pyarrow as pa

        classes = make_classes(letters)
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                found = [np.zeros(0, dtype=np.int64)]
                for at in range(0, len(t), PART):
                    c = classes(t[at:at + PART + LONGEST - 1]).astype(np.int64) + 1
                    code = np.zeros(len(c), dtype=np.int64)
                    for n in range(min(LONGEST, len(c))):
                        code = code[:len(c) - n] * (base + 1) + c[n:]
                        found.append(np.unique(code))
                    found = [np.unique(np.concatenate(found))]
                out.append(found[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["codes"])

    own = sample.select("text", F.row_number().over(_by_hash()).alias("k")).where(F.col("k") <= each).select("text")
    # At most ``landmarks`` rows of at most as many runs as classes allow.
    held = [np.frombuffer(r[0], dtype=np.int64) for r in own.mapInArrow(coded, "codes binary").collect()]
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    # A run's beginnings are held wherever it is, so the commonest runs hold theirs; ties prefer shorter runs, whose codes are smaller.
    kept = np.sort(codes[np.lexsort((codes, -n))[:RUNS]])
    return held, kept, len(held)


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("order_")


def _trie(codes):
    """The table of the kept runs: rows in the order of their codes, from 1."""
    import numpy as np

    base = LETTERS + 3
    row = {0: 0} | {int(c): i + 1 for i, c in enumerate(codes)}
    table = np.full((len(codes) + 2, LETTERS + 2), len(codes) + 1, dtype=np.int32)
    for c, r in row.items():
        if c:
            table[row[c // base], c % base - 1] = r
    return table


def _held(held: list, trie, n: int):
    """Packed bits: which run each landmark holds."""
    import numpy as np

    base = LETTERS + 3
    rows = np.zeros((len(trie), n), dtype=bool)
    for k, codes in enumerate(held):
        at = np.zeros(len(codes), dtype=np.int32)
        for power in (base * base, base, 1):
            digit = codes // power % base
            at = np.where(digit > 0, trie[at, np.maximum(digit - 1, 0)], at)
        rows[at, k] = True
    rows[-1] = False
    rows[0] = False
    return np.packbits(rows, axis=1)


def _weights(sample: DataFrame, model: Model):
    """Ridge regression on the landmarks: (K'K + ridge n K_mm) weights = K'Y, K'K and K'Y summed by tasks."""
    import numpy as np

    m, names = model.n_landmarks, {x: i for i, x in enumerate(model.languages)}

    def summed(batches):
        import pyarrow as pa

        kernel = make_kernel(model)
        left, right, n = np.zeros((m, m)), np.zeros((m, len(names))), 0
        for b in batches:
            langs, done = b.column(0).to_pylist(), 0
            for k, _ in kernel(b.column(1).to_pylist()):
                y = np.full((len(k), len(names)), -1.0)
                y[np.arange(len(k)), [names[x] for x in langs[done:done + len(k)]]] = 1.0
                k = k.astype(np.float64)
                left += k.T @ k
                right += k.T @ y
                done += len(k)
            n += len(langs)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["left", "right", "n"])

    left, right, n = np.zeros((m, m)), np.zeros((m, len(names))), 0
    # A matrix for each task over the sample, whose size is bounded.
    for r in sample.select("lang", "text").coalesce(16).mapInArrow(summed, "left binary, right binary, n bigint").collect():
        left += np.frombuffer(r[0]).reshape(m, m)
        right += np.frombuffer(r[1]).reshape(m, len(names))
        n += r[2]
    held = np.unpackbits(model.held, axis=1, count=m).astype(np.float64)
    held /= np.sqrt(np.maximum(held.sum(0), 1))
    return np.linalg.solve(left + RIDGE * max(n, 1) * (held.T @ held) + 1e-8 * np.eye(m), right)


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every whole text."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    key = hash((tuple(model.languages), model.weights.tobytes() if model.weights is not None else b""))

    def run(batches):
        import pyarrow as pa

        kernel = worker_memory(("language-kernel", key), lambda: make_kernel(model)) if model.languages else None
        for b in batches:
            names, scores = [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            if kernel is None:
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                for k, letters in kernel(texts):
                    found = k @ model.weights
                    best = found.argmax(1)
                    # +1 for the language and -1 for the rest are what the regression aims at.
                    share = ((found.max(1) + 1) / 2).clip(0.0, 1.0)
                    names += [model.languages[i] if a else UNKNOWN for i, a in zip(best, letters)]
                    scores += [float(s) if a else 0.0 for s, a in zip(share, letters)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
