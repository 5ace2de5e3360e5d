"""Words of whole texts as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

#: Bytes hashed at once; longer texts are cut at white space.
BLOCK = 1 << 20


def make_hasher():
    """A function from a list of UTF-8 texts to (hashes of their words in order, text of each word).

    A-Z are lower-cased; words are runs of bytes other than U+0020 and U+0009
    to U+000D. A word's hash is a polynomial of its bytes modulo 2^64, read
    off a running sum, with its length, mixed; hashes are odd.
    """
    import numpy as np

    u = np.uint64
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    value = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * u(2) + u(1)
    value[65:91] = value[97:123]
    white = np.zeros(256, dtype=bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    powers: dict[str, np.ndarray] = {}

    def up_to(n: int):
        if len(powers.get("up", ())) < n:
            size = max(n, BLOCK + 1)
            for name, x in (("up", base), ("down", inverse)):
                run = np.full(size, x, dtype=u)
                run[0] = 1
                powers[name] = np.multiply.accumulate(run)
        return powers["up"], powers["down"]

    def hashed(data):
        """Hashes and starts of the words of an array of bytes."""
        n = len(data)
        up, down = up_to(n + 1)
        inside = np.concatenate([[False], ~white[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        total = np.zeros(n + 1, dtype=u)
        np.cumsum(value[data] * up[:n], out=total[1:])
        z = (total[ends] - total[starts]) * down[starts]
        z += (ends - starts).astype(u) * u(0xD6E8FEB86659FD93)
        z ^= z >> u(32)
        z *= u(0xBF58476D1CE4E5B9)
        z ^= z >> u(29)
        z *= u(0x94D049BB133111EB)
        z ^= z >> u(32)
        return z | u(1), starts

    def segments(t: bytes):
        at = 0
        while len(t) - at > BLOCK:
            end = max(t.rfind(w, at, at + BLOCK) for w in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if end <= at:
                later = [k for w in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (k := t.find(w, at + BLOCK)) >= 0]
                end = min(later, default=len(t))
            yield t[at:end]
            at = end
        yield t[at:]

    def run(texts: list[bytes]):
        hashes, owners = [], []

        def flush(block: list[bytes], first: int):
            if block:
                h, starts = hashed(np.frombuffer(b"\n".join(block), dtype=np.uint8))
                heads = np.cumsum([0, *(len(t) + 1 for t in block[:-1])])
                hashes.append(h)
                owners.append(np.searchsorted(heads, starts, "right") - 1 + first)

        block, size, first = [], 0, 0
        for k, t in enumerate(texts):
            if len(t) > BLOCK:
                flush(block, first)
                for part in segments(t):
                    h, _ = hashed(np.frombuffer(part, dtype=np.uint8))
                    hashes.append(h)
                    owners.append(np.full(len(h), k, dtype=np.int64))
                block, size, first = [], 0, k + 1
                continue
            block.append(t)
            size += len(t) + 1
            if size >= BLOCK:
                flush(block, first)
                block, size, first = [], 0, k + 1
        flush(block, first)
        if not hashes:
            return np.zeros(0, dtype=u), np.zeros(0, dtype=np.int64)
        return np.concatenate(hashes), np.concatenate(owners)

    return run


def shingled(hashes, owners, k: int):
    """(hash, text) of every run of ``k`` words of one text; ``k`` is part of the hash."""
    import numpy as np

    u = np.uint64
    n = len(hashes) - k + 1
    if n < 1:
        return hashes[:0], owners[:0]
    z = np.full(n, k, dtype=u)
    for i in range(k):
        z *= u(0x9E3779B97F4A7C15)
        z += hashes[i:n + i]
        z ^= z >> u(32)
    z *= u(0xBF58476D1CE4E5B9)
    z ^= z >> u(29)
    z *= u(0x94D049BB133111EB)
    z ^= z >> u(32)
    same = owners[:n] == owners[k - 1:]
    return z[same], owners[:n][same]
