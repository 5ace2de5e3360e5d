"""Texts cut at boundaries that byte-level pre-tokenisation never crosses.

With the pattern of the byte-level vocabularies a single space between two
characters that are not white space always starts a new match, so a text is
the sequence of its pieces and each distinct piece needs work only once.
"""

from __future__ import annotations


class Numbers(dict):
    """Piece -> number in order of first sight; ``fresh`` holds what nobody has worked on yet.

    Pieces after a text's first one stand under their body, without the space
    that starts them; first pieces stand under (piece,). ``loose`` says that a
    body is not a piece: it is empty or white space is at its ends.
    """

    def __init__(self):
        self.fresh: list[str] = []
        self.count = 0
        self.loose = -1

    def clear(self) -> None:
        super().clear()
        self.fresh.clear()
        self.count = 0

    def _next(self, piece: str) -> int:
        self.fresh.append(piece)
        self.count += 1
        return self.count - 1

    def __missing__(self, key):
        if isinstance(key, tuple):
            n = self[key] = self._next(key[0])
        elif not key or key[0].isspace() or key[-1].isspace():
            n = self[key] = self.loose
        else:
            n = self[key] = self._next(" " + key)
        return n


def make_cutter():
    """A function (texts, Numbers) -> (numbers of the pieces of all texts, pieces of each text)."""
    import re

    import numpy as np

    boundary = re.compile(r"(?<=\S) (?=\S)")

    def cut(texts: list[str], known: Numbers):
        split = [t.split(" ") for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = [p for parts in split for p in parts]
        out = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # A first piece has no space before it and may start with one; a text with loose pieces is cut with care.
        loose = np.concatenate([[0], np.cumsum(out == known.loose)])
        bad = loose[ends] > loose[starts]
        firsts = [(parts[0],) for parts in split]
        out[starts] = np.fromiter((known[f] if not b else 0 for f, b in zip(firsts, bad.tolist(), strict=True)), dtype=np.int64, count=len(firsts))
        if not bad.any():
            return out, sizes
        pieces = []
        for k, (b, a, e) in enumerate(zip(bad.tolist(), starts.tolist(), ends.tolist(), strict=True)):
            if b:
                first, *rest = boundary.split(texts[k])
                own = [known[(first,)], *(known[(" " + p,)] if known[p] == known.loose else known[p] for p in rest)]
                pieces.append(np.array(own, dtype=np.int64))
            else:
                pieces.append(out[a:e])
        return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)

    return cut
