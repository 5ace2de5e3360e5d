"""Repair of conversation structure by weighted finite-state composition.

The turns of a conversation are an input acceptor, a path of one arc a turn.
An edit transducer keeps, changes the role of, deletes or inserts turns at a
cost; a grammar acceptor allows the role sequences ``(s?(ua)+)?``. The three
are composed lazily: only pairs (place in the conversation, grammar state) that
a path reaches are made, in topological order, and the shortest path is taken
by the weight (cost, edit initials), compared one after the other. Two paths
of equal cost to one pair never have one's initials begin with the other's,
since further initials at the same place are insertions and cost more; so the
weights form a semiring and blocks of turns can be composed for themselves.

That is how a conversation of any length is split: compact rows (ids, role,
digest and faults, no text) are sorted by range, so that one conversation may
cross many tasks, and each block of at most ``BLOCK`` turns becomes a small
matrix of weights from each grammar state to each. The matrices of a
conversation are multiplied in order with the decided beginning of the path
let go as soon as all states agree on it. The edits then meet the texts by
(conversation, turn, digest): texts are moved once, spread by these keys.

Order: by turn, nulls first; turns of the same number by role and then by the
digest of their content. A turn's first fault counts: blank (nothing but white
space), duplicate (role and text stood earlier), truncated (the last character
that is not white space ends no sentence).

Defined results: a null role or text counts as one space; null ids form one
conversation; a null turn has no number (it makes no gap) and comes first;
repeated rows are duplicates of the first; a conversation without turns is
repaired to nothing by no edits; an empty table gives no rows; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The grammar (s?(ua)+)? by states, and the costs of edits.
GRAMMAR = {("start", "s"): "system", ("start", "u"): "user", ("system", "u"): "user", ("user", "a"): "answered", ("answered", "u"): "user"}
FINAL = ("start", "answered")
STATES = ("start", "system", "user", "answered")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Turns of one block.
BLOCK = 2048
#: Shortest paths of short conversations that a task remembers.
MEMORY = 50_000


def damage(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies (0 or more) after faults planted by crc32 of ``conv_id:turn``, modulo 20.

    0 drops a row (copies is 0: its conversation is still known), 1 empties its
    text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(turns[c].cast("string"), space)
    kind = F.crc32(F.concat(as_text(conv_id), F.lit(":"), as_text(turn)).cast("binary")) % 20
    out = turns.select(turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return out.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


@dataclass
class Repair:
    """What ``repair`` returns."""

    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row a conversation.
    summary: DataFrame
    #: conv_id, part, block, place, edit, role, text: the repaired turns, in this order within a conversation.
    turns: DataFrame


def make_shortest():
    """A function from (classes of turns, start state) to {end state: (cost, edit initials)}.

    A class is two characters: the role's initial (``x``: none of the grammar's)
    and what holds for the turn: ``.`` nothing, ``!`` it must go, ``~`` it is
    truncated. It runs in workers, so it has all it needs inside.
    """
    grammar, keep, rerole, delete, insert, truncated, roles, memory = GRAMMAR, KEEP, REROLE, DELETE, INSERT, TRUNCATED, "".join(ROLES), MEMORY
    known: dict = {}

    def arcs(state, cls):
        """Arcs of input and edit composed with those of the grammar: (end state, cost, initial)."""
        initial, fault = cls[0], cls[1]
        found = [(state, delete, "D")]
        if fault != "!":
            more = truncated if fault == "~" else 0
            if (state, initial) in grammar:
                found.append((grammar[state, initial], keep + more, "K"))
            found += [(grammar[state, r], rerole + more, "R") for r in roles if (state, r) in grammar]
        return found

    def inserted(at):
        """Insertions before the next turn. Two reach every state: a third would come back to one at a higher cost."""
        level = at
        for _ in range(2):
            after: dict = {}
            for state, (cost, labels) in level.items():
                for r in roles:
                    to = grammar.get((state, r))
                    if to is not None and (to not in after or (cost + insert, labels + "I") < after[to]):
                        after[to] = (cost + insert, labels + "I")
            level = {to: w for to, w in after.items() if to not in at or w < at[to]}
            at = at | level
        return at

    def run(classes, start):
        key = (classes, start)
        found = known.get(key)
        if found is None:
            at = inserted({start: (0, "")})
            for k in range(0, len(classes), 2):
                after: dict = {}
                for state, (cost, labels) in at.items():
                    for to, more, initial in arcs(state, classes[k:k + 2]):
                        w = (cost + more, labels + initial)
                        if to not in after or w < after[to]:
                            after[to] = w
                at = inserted(after)
            found = at
            if len(classes) < 64:
                if len(known) >= memory:
                    known.clear()
                known[key] = found
        return found

    return run


def _identity() -> Column:
    """Names a turn's conversation, number and content; never null."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part("conv_id"), F.lit(":"), part("turn"), F.lit(":"), F.col("digest")).cast("binary"))


def _compact(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, truncated, copies, later: rows that are alike added up, ``later`` where their content stood in an earlier turn."""
    alike = rows.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    first = alike.where("copies > 0").groupBy(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    same = alike["conv_id"].eqNullSafe(first["first_conv"]) & (alike["digest"] == first["first_digest"])
    return alike.join(first, same, "left").select(*alike.columns, (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"))


EDITED = ("conv_id {id}, part int, block bigint, kept array<struct<place:int,edit:string,role:string,turn:{turn},digest:string>>, "
          "summary struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>")
BLOCKS = EDITED + ", turns array<{turn}>, roles array<string>, digests array<string>, faults string, paths array<struct<start:string,end:string,cost:bigint,labels:string>>"


def make_editor():
    """Functions that apply edit initials to a block's turns and add up a conversation's figures."""
    grammar, roles = GRAMMAR, ROLES
    legal = {"su", "ua", "au"}

    def applied(block, labels, state):
        """The turns that stay, as rows of ``kept``, and the grammar state after them."""
        kept, i = [], 0
        for place, edit in enumerate(labels):
            if edit == "D":
                i += 1
                continue
            initial = block["roles"][i][:1] if edit == "K" else next(r for r in roles if (state, r) in grammar)
            own = edit != "I"
            kept.append({"place": place, "edit": edit, "role": block["roles"][i] if edit == "K" else roles[initial], "turn": block["turns"][i] if own else None, "digest": block["digests"][i] if own else None})
            state = grammar[state, initial]
            i += own
        return kept, state

    class Figures:
        """Sums over the blocks of one conversation, in order."""

        def __init__(self):
            self.counts = {"b": 0, "d": 0, "~": 0, ".": 0}
            self.illegal = self.numbers = 0
            self.least = self.last = self.initial = None

        def add(self, block):
            for turn, role, fault in zip(block["turns"], block["roles"], block["faults"]):
                self.counts[fault] += 1
                self.illegal += self.initial is not None and self.initial + role[:1] not in legal
                self.initial = role[:1]
                if turn is not None and turn != self.last:
                    self.numbers += 1
                    self.last = turn
                    self.least = turn if self.least is None else self.least

        def summary(self, cost, audit):
            gaps = 0 if self.last is None else int(self.last - self.least + 1 - self.numbers)
            return {"gaps": gaps, "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["~"], "illegal": self.illegal, "cost": cost, "audit": audit}

    return applied, Figures


def _in_order(batches):
    """Rows of Arrow batches as dicts."""
    for b in batches:
        yield from b.to_pylist()


def _packed(records, schema, rows: int = 500):
    """Arrow batches of dicts."""
    import pyarrow as pa

    batch = []
    for r in records:
        batch.append(r)
        if len(batch) >= rows:
            yield pa.RecordBatch.from_pylist(batch, schema=schema)
            batch = []
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema=schema)


def _arrow(spec: str):
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))


def _blocks(compact: DataFrame, types: dict, size: int) -> DataFrame:
    """Blocks of at most ``size`` turns, in order. One that holds a conversation whole is settled at once; others get their matrices of weights."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    arranged = compact.repartitionByRange(common.partitions(compact.sparkSession), *order).sortWithinPartitions(*order)
    schema, states, final = _arrow(BLOCKS.format(**types)), STATES, FINAL

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shortest, (applied, figures) = make_shortest(), make_editor()

        def gathered():
            """(block, whether it begins its conversation for certain, whether it ends it for certain)."""
            block, number, begins, earlier = None, 0, False, None
            for row in _in_order(batches):
                if block is None or row["conv_id"] != block["conv_id"]:
                    if block is not None:
                        yield block, begins, True
                    # The first conversation of a partition may have begun in the one before.
                    begins = block is not None
                    number += 1
                    block = {"conv_id": row["conv_id"], "part": part, "block": number, "turns": [], "roles": [], "digests": [], "faults": []}
                    earlier = None
                for _ in range(row["copies"]):
                    if len(block["turns"]) >= size:
                        yield block, begins, False
                        begins = False
                        number += 1
                        block = {"conv_id": row["conv_id"], "part": part, "block": number, "turns": [], "roles": [], "digests": [], "faults": []}
                    # Rows that are alike stand side by side.
                    duplicate = row["later"] or earlier == (row["turn"], row["digest"])
                    earlier = (row["turn"], row["digest"])
                    block["turns"].append(row["turn"])
                    block["roles"].append(row["role"])
                    block["digests"].append(row["digest"])
                    block["faults"].append("b" if row["blank"] else "d" if duplicate else "~" if row["truncated"] else ".")
            if block is not None:
                yield block, begins, False

        def settled():
            for block, begins, ends in gathered():
                classes = "".join((r[:1] if r[:1] in ("s", "u", "a") else "x") + ("!" if f in "bd" else f) for r, f in zip(block["roles"], block["faults"]))
                if begins and ends:
                    paths = shortest(classes, "start")
                    cost, labels = min(paths[q] for q in final if q in paths)
                    own = figures()
                    own.add(block)
                    yield {"conv_id": block["conv_id"], "part": part, "block": block["block"], "kept": applied(block, labels, "start")[0], "summary": own.summary(cost, labels)}
                else:
                    paths = [{"start": q, "end": to, "cost": c, "labels": labels} for q in states for to, (c, labels) in shortest(classes, q).items()]
                    yield block | {"faults": "".join(block["faults"]), "paths": paths}

        yield from _packed(settled(), schema, 200)

    return arranged.mapInArrow(run, BLOCKS.format(**types))


def _multiplied(blocks: DataFrame, types: dict) -> DataFrame:
    """Conversations that cross blocks: their matrices multiplied in order, as rows of ``EDITED``."""
    schema, final = _arrow(EDITED.format(**types)), FINAL
    # A block is a few KB for thousands of turns; a worker reads a conversation's blocks in a stream.
    arranged = blocks.repartition(common.partitions(blocks.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block")

    def run(batches):
        applied, figures = make_editor()

        def settled():
            name, ways, held = None, None, []

            def let_go(way):
                """The earliest held blocks, whose labels are the first of ``way``."""
                for labels in way:
                    block = held.pop(0)
                    kept, state[0] = applied(block, labels, state[0])
                    audit.append(labels)
                    yield {"conv_id": block["conv_id"], "part": block["part"], "block": block["block"], "kept": kept}

            def ended():
                cost, _, way = min((c, "".join(w), w) for q, (c, w) in ways.items() if q in final)
                rows = list(let_go(way))
                rows[-1]["summary"] = own.summary(cost, "".join(audit))
                return rows

            for block in _in_order(batches):
                if ways is None or block["conv_id"] != name:
                    if ways is not None:
                        yield from ended()
                    name, ways, held, own, state, audit = block["conv_id"], {"start": (0, ())}, [], figures(), ["start"], []
                own.add(block)
                after: dict = {}
                for p in block["paths"]:
                    if p["start"] in ways:
                        cost, way = ways[p["start"]]
                        after.setdefault(p["end"], []).append((cost + p["cost"], (*way, p["labels"])))
                ways = {q: min(found, key=lambda x: (x[0], "".join(x[1]))) for q, found in after.items()}
                held.append(block)
                agreed = 0
                some = next(iter(ways.values()))[1]
                while agreed < len(some) - 1 and all(w[agreed] == some[agreed] for _, w in ways.values()):
                    agreed += 1
                if agreed:
                    yield from let_go(some[:agreed])
                    ways = {q: (c, w[agreed:]) for q, (c, w) in ways.items()}
            if ways is not None:
                yield from ended()

        yield from _packed(settled(), schema, 50)

    columns = ["conv_id", "part", "block", "turns", "roles", "digests", "faults", "paths"]
    return arranged.select(*columns).mapInArrow(run, EDITED.format(**types))


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block: int = BLOCK) -> Repair:
    """The cheapest edits that give every conversation roles ``(s?(ua)+)?``; ``copies`` names a column of how often a row counts (0: only its conversation)."""
    space = F.lit(" ")
    own_role, own_text = F.coalesce(turns[role].cast("string"), space), F.coalesce(turns[text].cast("string"), space)
    rows = turns.select(
        turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), own_role.alias("role"), own_text.alias("text"), (turns[copies] if copies else F.lit(1)).cast("bigint").alias("copies"),
        F.md5(F.concat(F.length(own_role).cast("string"), F.lit(":"), own_role, own_text).cast("binary")).alias("digest"))
    types = {"id": rows.schema["conv_id"].dataType.simpleString(), "turn": rows.schema["turn"].dataType.simpleString()}
    faulty = rows.select("conv_id", "turn", "role", "digest", "copies", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")).alias("truncated"))
    blocks, _ = common.write_table(_blocks(_compact(faulty), types, block), "conversation-blocks")
    names = ["conv_id", "part", "block", "kept", "summary"]
    edited, _ = common.write_table(blocks.where("paths IS NULL").select(*names).unionByName(_multiplied(blocks.where("paths IS NOT NULL"), types)), "conversation-edits")
    kept = edited.select("conv_id", "part", "block", F.explode("kept").alias("k")).select("conv_id", "part", "block", "k.*")
    old = kept.where("digest IS NOT NULL").withColumn("identity", _identity())
    # One of the rows that are alike; the key is never null, so the sums and the join share a partitioning.
    texts = rows.where("copies > 0").select(_identity().alias("identity"), "text").groupBy("identity").agg(F.first("text").alias("text"))
    out = ["conv_id", "part", "block", "place", "edit", "role", "text"]
    repaired = old.join(texts, "identity").select(*out).unionByName(kept.where("digest IS NULL").withColumn("text", F.lit("")).select(*out))
    return Repair(edited.where("summary IS NOT NULL").select("conv_id", "summary.*"), repaired)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 (lower-case hex) of a conversation's ``role:text`` lines; texts stream through a worker, none is gathered."""
    common.small_batches(repaired.sparkSession)
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "part", "block", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    arranged = lines.repartition(common.partitions(repaired.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block", "place").select("conv_id", "line")
    schema = _arrow(f"conv_id {kind}, repaired_sha256 string")

    def run(batches):
        import hashlib

        def hashed():
            name, state = None, None
            for row in _in_order(batches):
                if state is None or row["conv_id"] != name:
                    if state is not None:
                        yield {"conv_id": name, "repaired_sha256": state.hexdigest()}
                    name, state = row["conv_id"], hashlib.sha256(row["line"].encode())
                else:
                    state.update(b"\n" + row["line"].encode())
            if state is not None:
                yield {"conv_id": name, "repaired_sha256": state.hexdigest()}

        yield from _packed(hashed(), schema)

    return arranged.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
