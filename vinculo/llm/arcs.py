"""Finite paths between pieces: greedy merging as a shortest-path problem."""

from __future__ import annotations

from collections.abc import Callable, Container

#: Remembered arcs per worker.
MAX_ARCS = 1_000_000


class PieceArcs:
    """The arc from piece ``a`` to piece ``b`` is finite iff the merges leave the two apart.

    Greedy merging never looks past a boundary that it keeps. So a sequence of pieces is the
    merge result of its text exactly when each neighbouring pair alone merges to itself, and each
    prefix of a text has at most one such sequence. The search takes the longest piece first and
    steps back where no finite arc goes on; a position that failed is not tried again, so the work
    is bounded by positions times piece length.
    """

    def __init__(self, pieces: Container[str], merged: Callable[[str], list[str]], longest: int, free_characters: bool) -> None:
        self.pieces, self.merged, self.longest, self.free = pieces, merged, longest, free_characters
        self.arcs: dict[str, dict[str, bool]] = {}
        self.known = 0

    def finite(self, before: str, piece: str, row: dict[str, bool]) -> bool:
        self.known += 1
        if self.known > MAX_ARCS:
            self.arcs.clear()
            self.known = 0
        ok = row[piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return ok

    def path(self, unit: str) -> list[str]:
        """The pieces of ``unit``; characters without a piece stand alone if that is allowed."""
        pieces, longest, n = self.pieces, self.longest, len(unit)
        out: list[str] = []
        dead: set[int] = set()
        pos, before, size = 0, "", min(longest, n)
        while pos < n:
            row = self.arcs.get(before)
            if row is None:
                row = self.arcs[before] = {}
            while size:
                piece = unit[pos : pos + size]
                if (piece in pieces or (size == 1 and self.free)) and (pos + size) not in dead:
                    ok = row.get(piece)
                    if ok or (ok is None and self.finite(before, piece, row)):
                        break
                size -= 1
            if size:
                out.append(piece)
                pos += size
                before = piece
                size = min(longest, n - pos)
            else:
                dead.add(pos)
                size = len(before) - 1
                pos -= len(before)
                out.pop()
                before = out[-1] if out else ""
        return out
