"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words (matches of the pattern) of a block of the corpus are laid out once
each in one array of tokens. An inverted index leads from a token pair, named
by the rank of its merge, to the positions that hold it. Merges are replayed
in rank order over the whole block, all words that hold a pair at once (from
left to right where a word holds it twice); each application updates only the
two neighbours it touches. A text is a sequence of pieces, whose ids are read
off by their numbers. A block is the distinct new words of a share of a
partition, bounded in bytes, so memory doesn't grow with the corpus and no row
is shuffled; a worker remembers the words of earlier blocks.

Defined results: a null text is empty (no ids); text that the pattern doesn't
match is skipped; repeated rows are encoded each for itself; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import common
from .common import worker_memory
from .pieces import Numbers, make_cutter

#: Bytes of distinct words replayed at once.
BLOCK_BYTES = 1 << 21
#: Bytes of texts whose new words are learned together.
GROUP_BYTES = 12_000_000
#: Merges of one rank up to this number are applied one by one.
FEW = 6
#: Pieces whose ids a Python worker remembers; beyond it the memory starts anew.
MEMORY_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]):
    """left, right, rank of every pair of tokens that a merge makes one token, sorted by left and right."""
    import numpy as np

    get = ranks.get
    found = [(a, b, r) for token, r in ranks.items() for cut in range(1, len(token)) if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None]
    table = np.array(found, dtype=np.int32).reshape(-1, 3)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def make_replay(ranks: dict[bytes, int]):
    """A function from a list of words to (their ids in one array, the number of ids of each)."""
    import numpy as np

    end = max(ranks.values()) + 1  # stands between words; in no pair
    table = pair_table(ranks)
    by_left = np.searchsorted(table[:, 0], np.arange(end + 2)).tolist()
    rights, right_ranks = table[:, 1].copy(), table[:, 2].copy()
    turned = table[np.lexsort((table[:, 0], table[:, 1]))]
    by_right = np.searchsorted(turned[:, 1], np.arange(end + 2)).tolist()
    lefts, left_ranks = turned[:, 0].copy(), turned[:, 2].copy()
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
    if (single < 0).any():
        raise ValueError("the vocabulary lacks single bytes")
    first = np.full((256, 256), -1, dtype=np.int32)
    byte_of = {int(r): b for b, r in enumerate(single)}
    for left, right, r in table.tolist():
        if left in byte_of and right in byte_of:
            first[byte_of[left], byte_of[right]] = r

    def among(names, values, tokens):
        """The value of each token that ``names`` (sorted) holds, or -1."""
        at = np.searchsorted(names, tokens)
        at[at == len(names)] = 0
        return np.where(names[at] == tokens, values[at], -1)

    def replay(words: list[bytes]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + 1) - sizes  # a word end stands before the first word and after each
        n = int(sizes.sum()) + len(words) + 1
        inside = np.ones(n, dtype=bool)
        inside[starts - 1] = inside[n - 1] = False
        data = np.zeros(n, dtype=np.uint8)
        data[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.full(n, -1, dtype=np.int32)  # rank of the pair that starts here
        at[:-1] = np.where(inside[:-1] & inside[1:], first[data[:-1], data[1:]], -1)
        token = np.where(inside, single[data], end).astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        word_of = np.cumsum(~inside, dtype=np.int32)
        places = np.flatnonzero(at >= 0).astype(np.int32)
        places = places[np.argsort(at[places], kind="stable")]
        edge = np.searchsorted(at[places], np.arange(end + 1)).tolist()
        later: list[list[int]] = [[] for _ in range(end)]  # pairs that merges made, by rank

        def note(s, i) -> int:
            """Enter the positions whose new pair merges; the lowest such rank."""
            ok = s >= 0
            if not ok.any():
                return end
            s, i = s[ok], i[ok]
            for k, v in zip(s.tolist(), i.tolist()):
                later[k].append(v)
            return int(s.min())

        def together(r: int, found) -> int:
            """Merge at positions of different words at once."""
            j = after[found]
            k, h = after[j], before[found]
            after[found], before[k], token[found] = k, found, r
            token[j] = at[j] = -1
            a, b = by_left[r], by_left[r + 1]
            s = among(rights[a:b], right_ranks[a:b], token[k]) if a < b else np.full(len(k), -1, dtype=np.int32)
            at[found] = s
            low = note(s, found)
            a, b = by_right[r], by_right[r + 1]
            s = among(lefts[a:b], left_ranks[a:b], token[h]) if a < b else np.full(len(h), -1, dtype=np.int32)
            at[h] = s
            return min(low, note(s, h))

        def one_by_one(r: int, found: list[int]) -> int:
            """Merge from left to right; a word in which a merge of lower rank came up waits."""
            low, waiting = end, set()
            own_rights = dict(zip(rights[by_left[r]:by_left[r + 1]].tolist(), right_ranks[by_left[r]:by_left[r + 1]].tolist()))
            own_lefts = dict(zip(lefts[by_right[r]:by_right[r + 1]].tolist(), left_ranks[by_right[r]:by_right[r + 1]].tolist()))
            for i in found:
                if at[i] != r:
                    continue
                if waiting and int(word_of[i]) in waiting:
                    later[r].append(i)
                    continue
                j, h = int(after[i]), int(before[i])
                k = int(after[j])
                after[i], before[k], token[i] = k, i, r
                token[j] = at[j] = -1
                for p, s in ((i, own_rights.get(int(token[k]), -1)), (h, own_lefts.get(int(token[h]), -1))):
                    at[p] = s
                    if s >= 0:
                        later[s].append(p)
                        low = min(low, s)
                        if s < r:
                            waiting.add(int(word_of[i]))
            return low

        r = 0
        while r < end:
            a, b = edge[r], edge[r + 1]
            more = later[r]
            if a == b and not more:
                r += 1
                continue
            found = places[a:b]
            edge[r] = b  # taken
            if more:
                later[r] = []
                found = np.sort(np.concatenate([found, np.array(more, dtype=np.int32)]))
            found = found[at[found] == r]
            low = end
            if len(found) > FEW:
                w = word_of[found]
                same = w[1:] == w[:-1]
                if same.any():
                    several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                    low = one_by_one(r, found[several].tolist())
                    found = found[~several]
                if len(found):
                    low = min(low, together(r, found))
            elif len(found):
                low = one_by_one(r, found.tolist())
            if low < r:
                r = low
            elif not later[r]:
                r += 1
        alive = inside & (token >= 0)
        seen = np.concatenate([[0], np.cumsum(alive)])
        return token[alive].astype(np.uint32), seen[starts + sizes] - seen[starts]

    return replay


def ragged(starts, counts):
    """Positions of all elements of the stretches (start, count), one after another."""
    import numpy as np

    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def make_encoder(ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES, memory: int = MEMORY_PIECES):
    """A function from lists of texts to, for each list, (ids of all its texts, ids in each text)."""
    import numpy as np
    import regex

    find = regex.compile(pattern).findall
    replay, cut_texts = make_replay(ranks), make_cutter()
    known = Numbers()
    ids, start, count = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn() -> None:
        """Ids of the pieces that are new; their distinct words are replayed in blocks."""
        nonlocal ids, start, count
        found = [[w.encode() for w in find(p)] for p in known.fresh]
        flat = [w for ws in found for w in ws]
        word: dict[bytes, int] = {}
        number = np.fromiter((word.setdefault(w, len(word)) for w in flat), dtype=np.int64, count=len(flat))
        parts, sizes, block, size = [], [], [], 0
        for w in [*word, None]:
            if block and (w is None or size >= block_bytes):
                i, c = replay(block)
                parts.append(i)
                sizes.append(c)
                block, size = [], 0
            if w is not None:
                block.append(w)
                size += len(w)
        word_ids = np.concatenate(parts) if parts else ids[:0]
        word_count = np.concatenate(sizes) if sizes else count[:0]
        word_start = np.cumsum(word_count) - word_count
        # The words of a piece, one after another, are its ids.
        per_word = word_count[number]
        own = word_ids[ragged(word_start[number], per_word)]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        words_of = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))])
        piece = upto[words_of]
        start = np.concatenate([start, piece[:-1] + len(ids)])
        count = np.concatenate([count, np.diff(piece)])
        ids = np.concatenate([ids, own])
        known.fresh.clear()

    def encode(lists: list[list[str]]):
        nonlocal ids, start, count
        if len(start) > memory:
            known.clear()
            ids, start, count = ids[:0], start[:0], count[:0]
        cut = [cut_texts(texts, known) for texts in lists]
        if known.fresh:
            learn()
        for pieces, sizes in cut:
            c = count[pieces]
            upto = np.concatenate([[0], np.cumsum(c)])
            ends = np.cumsum(sizes)
            yield ids[ragged(start[pieces], c)], upto[ends] - upto[ends - sizes]

    return encode


def make_decoder(ranks: dict[bytes, int]):
    """A function (ids of several texts, ids in each) -> an Arrow array of their bytes."""
    import numpy as np
    import pyarrow as pa

    by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        by_id[r] = token
    tokens = pa.array(by_id, pa.large_binary())

    def decode(ids, counts):
        taken = tokens.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64, count=len(ids) + 1) if len(ids) else np.zeros(1, dtype=np.int64)
        at = edges[np.concatenate([[0], np.cumsum(counts)])]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), data if data is not None else pa.py_buffer(b"")])
        return whole.cast(pa.binary())

    return decode


def packed(ids, counts):
    """An Arrow array of the ids of each text, as little-endian unsigned 32-bit numbers."""
    import numpy as np
    import pyarrow as pa

    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
    data = pa.py_buffer(ids.astype("<u4").tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), data]).cast(pa.binary())


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded (bytes)."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def make():
            ranks = read_ranks(ranks_path)
            return make_encoder(ranks, pattern, block_bytes), make_decoder(ranks)

        encode, decode = worker_memory(("bpe", ranks_path, pattern, block_bytes), make)
        for group in grouped(batches, 1, group_bytes):
            for b, (ids, counts) in zip(group, encode([[t or "" for t in b.column(1).to_pylist()] for b in group]), strict=True):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), packed(ids, counts), decode(ids, counts)], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")


def grouped(batches, column: int, group_bytes: int):
    """Lists of batches of about ``group_bytes`` of text."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.column(column).get_total_buffer_size()
        if size >= group_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def decode(tokens: DataFrame, ranks_path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded: the bytes of packed ids; null ids are none."""
    kind = tokens.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        to_bytes = make_decoder(read_ranks(ranks_path))
        for b in batches:
            own = [np.frombuffer(x or b"", dtype="<u4") for x in b.column(1).to_pylist()]
            flat = np.concatenate(own) if own else np.zeros(0, dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0), to_bytes(flat, np.array([len(x) for x in own], dtype=np.int64))], ["doc_id", "decoded"])

    return tokens.select(tokens[doc_id].alias("doc_id"), tokens[ids].alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")
