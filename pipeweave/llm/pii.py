"""Personal data: base patterns and boosted trees over candidate spans.

Everything on the path of the texts is DataFrame expressions: no Python
function, pandas, Arrow or RDD code runs there. The positions of a pattern's
matches come from its gaps (``split``) and its matches
(``regexp_extract_all``), which share one left-to-right scan.

Base spans (email, ip, card, phone) are kept as they are. Further generators
with high recall propose overlapping candidates: key-value secrets, long
tokens with digits, loose phone numbers. Each candidate has yes/no figures of
its format. Labels for the fit are weak and come from elsewhere: a candidate
is positive if it overlaps a base span, has a secret's exact form, or follows
words that name what it is (a password, a telephone). Formats that mostly
occur with such evidence are then accepted where it lacks. All documents give one count for each pattern of figures and label,
folded by a hash of the id into a fit part and a calibration part (at most
2^15 rows, whatever the corpus), and gradient boosting of shallow trees is
fitted on these counts. Isotonic calibration on the other part turns
scores into shares of positives; the threshold is the lowest score whose
share reaches ``precision``. Trees
then score candidates as CASE expressions; accepted candidates that overlap
no base span and no better candidate become spans of kind ``secret``.

Patterns use possessive quantifiers and start only where a run of their first
class starts or the last match ended, so each is linear in the text; neither
changes what they match.

Defined results: a null or empty text has no spans; repeated rows are searched
each for itself; with no candidate in the table nothing is added; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, as linear Java patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this string or class has no match.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KEYWORD = "(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
#: Generators of further candidates.
MORE = {
    "pair": rf"(?i)(?<![A-Za-z]){KEYWORD}\x20?[=:]\x20?[\x22']?[A-Za-z0-9/+_.-]{{6,}}+[\x22']?",
    "token": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{8,}+",
    "digits": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Figures of a candidate c(hit, before, kind), as SQL: its format alone. What labels are made of (the words before it) is no figure.
FIGURES = [
    "c.hit rlike '[=:]'",
    "length(c.hit) >= 32",
    "length(regexp_replace(c.hit, '[^0-9]', '')) >= 8",
    "length(c.hit) >= 16",
    "c.hit rlike '[0-9a-f]{12}'",
    "c.hit rlike '^[A-Z0-9]+$'",
    "c.hit rlike '^[0-9 ().+-]+$'",
    "c.hit rlike '[A-Za-z]' AND c.hit rlike '[0-9]'",
    "c.kind = 'digits'",
    "2 * length(regexp_replace(c.hit, '[^0-9]', '')) > length(c.hit)",
    "c.hit rlike '^[A-Z]{4}[A-Z0-9]{12}'",
    "c.hit rlike '[a-z][A-Z]|[A-Z][a-z].*[0-9]|[0-9].*[A-Z][a-z]'",
]
#: Evidence for the weak labels: a secret's exact form, or words before the candidate that name what its kind holds.
EXACT = (f"c.hit rlike '(?i)^{KEYWORD} ?[=:]' OR c.hit rlike '^AKIA[0-9A-Z]{{16}}$' OR c.kind = 'token' AND c.before rlike '(?i)({KEYWORD}|bearer|authorization|credential|private)[^A-Za-z0-9]{{0,4}}$'"
         " OR c.kind = 'digits' AND c.before rlike '(?i)(phone|tel|mobile|fax|call|cell|telefon|telefono|appel|llame)[^A-Za-z0-9]{0,4}$'")
BEFORE = 24
#: Elements that are folded at once where arrays grow, so that a text of very many matches takes no square of them.
FOLD = 128
ROUNDS = 30
DEPTH = 2
RATE = 0.3
PRECISION = 0.95


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(pattern: str, needs: str, text: str = "text", before: bool = False) -> str:
    """SQL: array of (start, end, hit) of the pattern's matches, with ``before`` also the text just before; code points, end exclusive.

    What stands before a match is put together from its gap and the match
    before it: ``substring`` would read the text from its start for each match.
    """
    p = _literal(pattern)
    condition = f"contains({text}, '{needs}')" if len(needs) == 1 else f"{text} rlike {_literal(needs)}"
    kind = "array<struct<start:int,end:int,hit:string" + (",before:string" if before else "") + ">>"
    empty = f"cast(array() as {kind})"
    tail = f"'tail', right(x.hit, {BEFORE}), " if before else ""
    near = f", 'before', right(concat(own.tail, x.near), {BEFORE})" if before else ""
    start = "'tail', ''," if before else ""
    kept = "'tail', acc.tail," if before else ""
    some = f"""aggregate(part, named_struct('at', acc.at, {kept} 'found', {empty}),
      (own, x) -> CASE WHEN x.hit IS NULL THEN own ELSE named_struct('at', own.at + x.gap + length(x.hit), {tail} 'found',
        concat(own.found, array(named_struct('start', own.at + x.gap, 'end', own.at + x.gap + length(x.hit), 'hit', x.hit{near})))) END)"""
    gap = f"struct(length(g) AS gap, right(g, {BEFORE}) AS near, h AS hit)" if before else "struct(length(g) AS gap, h AS hit)"
    return f"""CASE WHEN {condition} THEN aggregate(
      {_folded(f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, h) -> {gap})")},
      named_struct('at', 0, {start} 'found', cast(array() as array<{kind}>)),
      (acc, part) -> transform(array({some}), r -> named_struct('at', r.at, {"'tail', r.tail," if before else ""} 'found', concat(acc.found, array(r.found))))[0],
      acc -> flatten(acc.found)) ELSE {empty} END"""


def _first(array: str, size: str, holds: str) -> str:
    """SQL: the number of elements ``x`` at the beginning of ``array`` for which ``holds`` is false; it must stay true once it is. A binary search."""
    return f"""aggregate(sequence(1, cast(ceil(log2({size} + 1)) as int)), named_struct('low', 0, 'high', {size}),
      (s, i) -> CASE WHEN s.low >= s.high THEN s WHEN transform(array({array}[(s.low + s.high) div 2]), x -> {holds})[0]
        THEN named_struct('low', s.low, 'high', cast((s.low + s.high) div 2 as int)) ELSE named_struct('low', cast((s.low + s.high) div 2 + 1 as int), 'high', s.high) END, s -> s.low)"""


def _overlaps(array: str, c: str = "c") -> str:
    """SQL: whether a span of ``array``, whose spans are apart and in order, overlaps ``c``."""
    first = _first(array, f"size({array})", f"x.end > {c}.start")
    return f"(size({array}) > 0 AND coalesce(get({array}, {first}).start < {c}.end, false))"


def _folded(array: str) -> str:
    """SQL: an array as an array of arrays of FOLD elements."""
    return f"transform(array({array}), z -> transform(sequence(0, greatest(size(z) - 1, 0) div {FOLD}), k -> slice(z, k * {FOLD} + 1, {FOLD})))[0]"


def _passing(kind: str) -> str:
    digits = "regexp_replace(s.hit, '[^0-9]', '')"
    if kind == "ip":
        return f"s.hit rlike {_literal(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "card":
        doubled = "2 * cast(substring(d, -i, 1) as int)"
        luhn = (f"aggregate(array({digits}), 0, (z, d) -> aggregate(sequence(1, length(d)), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN cast(substring(d, -i, 1) as int) "
                f"WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END)) % 10 = 0")
        return f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"
    return "true"


FIGURES.append(_passing("card").replace("s.hit", "c.hit"))


def base_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and an array (start, end, hit) for each base kind."""
    out = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    out = out.withColumns({k: F.expr(_spans(p, NEEDS[k])) for k, p in BASE.items()})
    return out.withColumns({k: F.expr(f"filter({k}, s -> {_passing(k)})") for k in BASE if k != "email"})


def _with_candidates(spans: DataFrame) -> DataFrame:
    """Adds ``candidates``: an array (start, end, figures, near, exact) for each generator, in order; ``near``: it overlaps a base span.

    All arrays are bound once by a lambda before candidates look into them: the
    optimizer would else put their expressions, with the scans of the text,
    inside the lambda over candidates. Spans of one kind are apart and in order,
    so a binary search finds those that a candidate overlaps.
    """
    found = ", ".join(f"'{k}', {_spans(p, '[0-9]' if k != 'pair' else '[=:]', before=True)}" for k, p in MORE.items())
    bound = f"array(named_struct({', '.join(f"'{k}', {k}" for k in BASE)}, {found}))"
    near = " OR ".join(_overlaps(f"z.{k}") for k in BASE)

    def judged(kind: str) -> str:
        bits = " + ".join(f"CASE WHEN {f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(FIGURES)).replace("c.kind", f"'{kind}'")
        return f"transform(z.{kind}, c -> named_struct('start', c.start, 'end', c.end, 'figures', {bits}, 'near', {near}, 'exact', {EXACT.replace('c.kind', f"'{kind}'")}))"

    return spans.withColumn("candidates", F.expr(f"transform({bound}, z -> named_struct({', '.join(f"'{k}', {judged(k)}" for k in MORE)}))[0]"))


def _boost(counts: list[tuple[int, int, float]]) -> tuple[float, list]:
    """Trees over bit patterns from (pattern, label, count): the bias and, for each tree, its nested splits."""
    total = sum(c for _, _, c in counts)
    pos = sum(c for _, y, c in counts if y)
    bias = math.log((pos + 0.5) / (total - pos + 0.5))
    score = {p: bias for p, _, _ in counts}

    def leaf(rows):
        g = sum(c * (y - s) for _, y, c, s in rows)
        h = sum(c * s * (1 - s) for _, _, c, s in rows)
        return g, h + 1.0

    def grow(rows, depth):
        g, h = leaf(rows)
        best = (1e-6, None)
        if depth:
            for i in range(len(FIGURES)):
                left, right = [r for r in rows if r[0] >> i & 1], [r for r in rows if not r[0] >> i & 1]
                if left and right:
                    (a, b), (c, d) = leaf(left), leaf(right)
                    gain = a * a / b + c * c / d - g * g / h
                    if gain > best[0]:
                        best = (gain, (i, left, right))
        if best[1] is None:
            return RATE * g / h
        i, left, right = best[1]
        return i, grow(left, depth - 1), grow(right, depth - 1)

    trees = []
    for _ in range(ROUNDS if 0 < pos < total else 0):
        rows = [(p, y, c, 1 / (1 + math.exp(-score[p]))) for p, y, c in counts]
        trees.append(grow(rows, DEPTH))
        for p in score:
            score[p] += value(trees[-1], p)
    return bias, trees


def value(tree, pattern: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if pattern >> tree[0] & 1 else tree[2]
    return tree


def _tree_sql(tree, figures: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN {figures} & {1 << tree[0]} != 0 THEN {_tree_sql(tree[1], figures)} ELSE {_tree_sql(tree[2], figures)} END"


def fit(spans: DataFrame, precision: float = PRECISION) -> tuple[float, list, float] | None:
    """bias, trees, threshold; None where the table has no candidate of each label."""
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)) == 0
    every = F.concat(*(F.col(f"candidates.{k}") for k in MORE))
    rows = (_with_candidates(spans).select(part.alias("held"), F.explode(every).alias("c"))
            .groupBy("held", F.col("c.figures").alias("p"), F.expr("CASE WHEN c.near OR c.exact THEN 1 ELSE 0 END").alias("y")).count().collect())
    train = sorted((r["p"], r["y"], float(r["count"])) for r in rows if not r["held"])
    if len({y for _, y, _ in train}) < 2:
        return None
    bias, trees = _boost(train)
    scored = sorted(((bias + sum(value(t, r["p"]) for t in trees), r["y"], r["count"]) for r in rows if r["held"]), reverse=True)
    if not scored:
        scored = sorted(((bias + sum(value(t, p) for t in trees), y, c) for p, y, c in train), reverse=True)
    # Isotonic calibration: pools of falling score, each with its share of positives.
    pools: list[list[float]] = []
    for s, y, c in scored:
        if pools and pools[-1][2] == s:
            pools[-1][0] += c * y
            pools[-1][1] += c
        else:
            pools.append([c * y, c, s])
        while len(pools) > 1 and pools[-1][2] < pools[-2][2] and pools[-2][0] * pools[-1][1] < pools[-1][0] * pools[-2][1]:
            good, seen, low = pools.pop()
            pools[-1] = [pools[-1][0] + good, pools[-1][1] + seen, low]
    threshold = min((low for good, seen, low in pools if good >= precision * seen), default=math.inf)
    return bias, trees, threshold


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, text, the four base arrays and ``secret``, the added spans (start, end)."""
    spans = base_spans(docs, doc_id=doc_id, text=text)
    model = fit(spans, precision)
    if model is None or model[2] == math.inf:
        return spans.withColumn("secret", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    bias, trees, threshold = model
    score = " + ".join([f"{bias!r}D", *(f"({_tree_sql(t, 'c.figures')})" for t in trees)])
    scored = {k: f"filter(transform(filter(candidates.{k}, c -> NOT c.near), c -> named_struct('score', {score}, 'start', c.start, 'end', c.end)), c -> c.score >= {threshold!r}D - 1e-9D)" for k in MORE}
    kinds = list(MORE)

    def beaten(kind: str) -> str:
        """SQL: a better candidate of another generator overlaps ``c``. Better: a higher score, then the longer span, then the earlier one, then the earlier generator."""
        ways = []
        for k in kinds:
            if k != kind:
                first, after = _first(f"z.{k}", f"size(z.{k})", "x.end > c.start"), _first(f"z.{k}", f"size(z.{k})", "x.start >= c.end")
                last = "<=" if kinds.index(k) < kinds.index(kind) else "<"
                better = ("b.score > c.score OR b.score = c.score AND (b.end - b.start > c.end - c.start OR b.end - b.start = c.end - c.start AND "
                          f"b.start {last} c.start)")
                ways.append(f"(size(z.{k}) > 0 AND exists(transform(array(named_struct('a', {first}, 'b', {after})), r -> slice(z.{k}, r.a + 1, greatest(r.b - r.a, 0)))[0], b -> {better}))")
        return " OR ".join(ways)

    kept = "concat(" + ", ".join(f"transform(filter(z.{k}, c -> NOT ({beaten(k)})), c -> named_struct('start', c.start, 'end', c.end))" for k in kinds) + ")"
    secret = f"transform(array(named_struct({', '.join(f"'{k}', {x}" for k, x in scored.items())})), z -> array_sort({kept}))[0]"
    return _with_candidates(spans).withColumn("secret", F.expr(secret)).select("doc_id", "text", *BASE, "secret")


def listed(kind: str) -> Column:
    """kind:start:end of a span column, in order of start."""
    return F.expr(f"transform({kind}, s -> concat('{kind}:', s.start, ':', s.end))")


def redacted(found: DataFrame) -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets.

    Spans go in parts of ``FOLD``: a part's piece of the text is cut out once
    and its spans are replaced inside it.
    """
    every = "array_sort(concat(" + ", ".join(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{k}'))" for k in [*BASE, "secret"]) + "))"
    piece = "substring(y.text, acc.at + 1, greatest(0, y.high - acc.at))"
    inner = """aggregate(part, named_struct('at', acc.at, 'out', ''), (own, s) -> CASE WHEN s.end <= own.at THEN own ELSE
        named_struct('at', s.end, 'out', concat(own.out, substring(w.piece, own.at - acc.at + 1, greatest(0, s.start - own.at)), '[', s.kind, ']')) END)"""
    step = f"""aggregate(z.parts, named_struct('at', 0, 'out', cast(array() as array<string>)),
      (acc, part) -> transform(array(named_struct('text', z.text, 'high', coalesce(array_max(transform(part, s -> s.end)), 0))), y ->
        transform(array(named_struct('piece', {piece})), w -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(acc.out, array(r.out))))[0])[0])[0],
      acc -> concat(array_join(acc.out, ''), substring(z.text, acc.at + 1)))"""
    return found.select("doc_id", F.expr(f"transform(array(named_struct('text', text, 'parts', {_folded(every)})), z -> {step})[0]").alias("text"))
