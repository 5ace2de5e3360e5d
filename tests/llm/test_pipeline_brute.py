"""Each stage of the pipeline against brute force on a small corpus, with labels and without any use of them."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pipeweave.llm import common

pytest.importorskip("public_tokenizers")
WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_corpus():
    """Documents, ids of the toxic ones and benchmark items."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    plain = lambda n: " ".join(r.choices(words, k=n))
    abuse = lambda: " ".join(f"{r.choice(words)} scumbag {r.choice(words)}" for _ in range(8))
    items = [plain(20) for _ in range(3)]
    line = "This very common line stands in many of the documents"
    base = plain(150)
    texts = [plain(60) for _ in range(30)] + [plain(20) + " " + abuse() + " " + plain(20) for _ in range(20)]
    texts += [plain(40) + "\n" + line + "\n" + plain(15) for _ in range(5)] + [base, base, base + " more", plain(5) + " " + base]
    texts += [plain(30) + " " + items[0] + " " + plain(30), items[1] + " " + plain(10), " ".join(items[2].split()[:8]) + " " + plain(20), "", None]
    toxic = {i for i, t in enumerate(texts) if "scumbag" in (t or "")}
    return list(enumerate(texts)), toxic, list(enumerate(items))


def without_lines(rows):
    key = lambda line: line.strip(WS).lower()
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return [(i, "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i)) for i, t in rows]


def shingles(t, k=5):
    ws = (t or "").lower().split()
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def without_copies(rows):
    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return [(i, t) for i, t in rows if group[i] == i]


def without_leaks(rows, items):
    def held(t, item):
        own = shingles(item)
        return len(own & shingles(t)) >= 0.8 * len(own)

    return [(i, t) for i, t in rows if not any(held(t, x) for _, x in items)]


LABELS = {
    "both classes": lambda n, toxic: [(i, 1, int(i in toxic)) for i in range(n)],
    "empty": lambda n, toxic: [],
    "other ids": lambda n, toxic: [(i + 1000, 1, i % 2) for i in range(n)],
    "all null": lambda n, toxic: [(i, 1, None) for i in range(n)],
    "all toxic": lambda n, toxic: [(i, 1, 1) for i in range(n)],
    "all clean": lambda n, toxic: [(i, 1, 0) for i in range(n)],
}


def written(spark, folder, case):
    rows, toxic, items = make_corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS[case](len(rows), toxic), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, items


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("case", sorted(LABELS))
def test_toxicity_stage(spark, tmp_path, case):
    rows, toxic, _ = written(spark, tmp_path, case)
    out = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert pairs(out) == Counter(r for r in rows if case != "both classes" or r[0] not in toxic)


@pytest.mark.parametrize("case", ["both classes", "empty"])
def test_all_stages(spark, tmp_path, case):
    rows, toxic, items = written(spark, tmp_path, case)
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    steps = [lambda x: [r for r in x if case == "empty" or r[0] not in toxic], without_lines, without_copies, lambda x: without_leaks(x, items), lambda x: [(i, t or "") for i, t in x]]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=True):
        docs, before, want = stage(spark, docs, str(tmp_path)), want, step(want)
        docs = common.table(docs, "stage")
        assert pairs(docs) == Counter(want), name
        if name not in ("toxicity", "byte_level_bpe"):
            assert want != before, name
    assert pairs(corpus_pipeline.run(spark, str(tmp_path))) == Counter(want)
