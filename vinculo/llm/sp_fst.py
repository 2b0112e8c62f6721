"""SentencePiece encoding and decoding as a weighted transducer over the tropical semiring."""

from __future__ import annotations

import functools
import math
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.texts import alone, map_batches

#: Remembered units, and arc weights between pieces, per Python worker.
CACHE_UNITS, CACHE_ARCS = 200_000, 400_000
SPACE = "▁"
#: Fixed values of the model format: kinds of models and pieces, and what an unknown character costs beyond the worst piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_COST = 10.0


class Normaliser:
    """The model's character map, white-space rules and prefix, as a deterministic transducer of texts.

    The map is a double-array trie over bytes whose leaves point to replacements. It is compiled into one state
    table: from each state a character leads to the next, and final states emit.
    """

    def __init__(self, spec) -> None:
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.squeeze = spec.remove_extra_whitespaces
        self.root: dict = {}
        if spec.precompiled_charsmap:
            self._compile(spec.precompiled_charsmap)

    def _compile(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        array = struct.unpack_from(f"<{size // 4}I", blob, 4)
        strings = blob[4 + size :]
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        stack = [(offset(array[0]), b"")]
        while stack:
            at, key = stack.pop()
            for byte in range(1, 256):
                if at ^ byte < len(array) and array[at ^ byte] & 0x800000FF == byte:
                    unit = array[at ^ byte]
                    below, longer = (at ^ byte) ^ offset(unit), key + bytes([byte])
                    if unit >> 8 & 1:
                        value = array[below] & 0x7FFFFFFF
                        node = self.root
                        for c in longer.decode():
                            node = node.setdefault(c, {})
                        node[""] = strings[value : strings.index(b"\0", value)].decode()
                    stack.append((below, longer))

    def mapped(self, text: str) -> str:
        """Longest entries of the character map replaced from left to right."""
        if not self.root:
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            node, end, emit, i = self.root.get(text[at]), at + 1, text[at], at + 1
            while node is not None:
                if "" in node:
                    end, emit = i, node[""]
                node = node.get(text[i]) if i < n else None
                i += 1
            out.append(emit)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", SPACE) if text else ""


class PieceTransducer:
    """normaliser o pieces o byte fallback, compiled from a model file of the unigram or the BPE kind.

    The pieces are a trie: its nodes are states, a character leads to the next, and at a piece's
    end an arc emits it and returns to the start. A character that no piece covers has an arc that emits its
    bytes (or the unknown piece). A unit of input is composed with it into a lattice whose states are
    positions, and the tropical shortest path from first to last is relaxed from left to right.

    Unigram arcs weigh minus the piece's score. BPE has no additive scores: there a state of the lattice is
    a position with the piece before it, and an arc to the next piece weighs 0 if the merges leave
    the two apart and infinity otherwise. Greedy merging never looks past a boundary that it keeps,
    so a position is reached by at most one piece at finite weight, and the path is the merges' result.

    Offline it is proved from all pieces which character pairs lie inside some piece. Between the
    other pairs there is always a boundary, so the input is cut there and each unit is composed
    with the transducer on its own; a worker remembers a bounded number of units.
    """

    def __init__(self, path: str | bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        m = model_pb2.ModelProto()
        if isinstance(path, bytes):
            m.ParseFromString(path)
        else:
            with open(path, "rb") as f:
                m.ParseFromString(f.read())
        kind = m.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are compiled")
        self.normalise = Normaliser(m.normalizer_spec)
        self.pieces = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.unk_cost = UNKNOWN_COST - min(self.scores.values(), default=0.0)
        of_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.output = [of_byte.get(i, b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(m.pieces)]
        self.shortest = self.cheapest if kind == UNIGRAM else self.stable
        self.trie: dict = {}
        for piece in self.pieces:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.units = re.compile(self._unit_pattern())
        self.apart: dict[str, dict[str, bool]] = {}
        self.known = 0
        self.cache: dict[str, list[int]] = {}

    def _unit_pattern(self) -> str:
        """Maximal runs across which some piece could reach; the rest is provably cut."""
        inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in inside):
            return "(?s).+"
        joiners: set[str] = set()
        letter = lambda c: c.isalpha() or c in joiners
        while more := {c for b in inside if SPACE not in b and letter(b[0]) != letter(b[1]) for c in b if not letter(c)}:
            joiners |= more
        extra = "".join(map(re.escape, sorted(joiners)))
        letters = rf"(?:[^\W\d_]|[{extra}])" if extra else r"[^\W\d_]"
        other = rf"(?:(?!{letters})[^{SPACE}])"
        # isalpha() and the class of the pattern agree but for letter-like numbers, which only makes units longer
        return rf"{SPACE}*(?:{letters}+|{other}+)|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """Greedy merging, the leftmost pair of the best score first; it defines the weights of BPE arcs."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _finite(self, before: str, piece: str, row: dict[str, bool]) -> bool:
        self.known += 1
        if self.known > CACHE_ARCS:
            self.apart.clear()
            self.known = 0
        ok = row[piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return ok

    def stable(self, unit: str) -> list[str]:
        """The path of weight 0 in the lattice of positions and last pieces; all others weigh infinity."""
        n = len(unit)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        apart, root = self.apart, self.trie
        for pos in range(n):
            before = last[pos]
            if before is None:
                continue
            row = apart.get(before)
            if row is None:
                row = apart[before] = {}
            node, end = root.get(unit[pos]), pos + 1
            if node is None or "" not in node:  # no piece: the character itself
                c = unit[pos]
                if last[end] is None and (row[c] if c in row else self._finite(before, c, row)):
                    last[end] = c
            while node is not None:
                piece = node.get("")
                if piece is not None and last[end] is None and (row[piece] if piece in row else self._finite(before, piece, row)):
                    last[end] = piece
                if end == n:
                    break
                node = node.get(unit[end])
                end += 1
        out, pos = [], n
        while pos:
            out.append(last[pos])
            pos -= len(out[-1])
        return out[::-1]

    def cheapest(self, unit: str) -> list[str]:
        """The path of least total weight in the lattice of positions."""
        n, scores = len(unit), self.scores
        cost, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for pos in range(n):
            node, end, here = self.trie.get(unit[pos]), pos + 1, cost[pos]
            if (node is None or "" not in node) and here + self.unk_cost < cost[end]:
                cost[end], last[end] = here + self.unk_cost, unit[pos]
            while node is not None:
                piece = node.get("")
                if piece is not None and here - scores[piece] < cost[end]:
                    cost[end], last[end] = here - scores[piece], piece
                if end == n:
                    break
                node = node.get(unit[end])
                end += 1
        out, pos = [], n
        while pos:
            out.append(last[pos])
            pos -= len(out[-1])
        return out[::-1]

    def unit_ids(self, unit: str) -> list[int]:
        found = self.cache.get(unit)
        if found is None:
            found = []
            for piece in self.shortest(unit):
                i = self.pieces.get(piece)
                if i is not None:
                    found.append(i)
                elif self.byte_ids:
                    found += [self.byte_ids[b] for b in piece.encode()]
                elif not found or found[-1] != self.unk:  # a run of unknown characters is one piece
                    found.append(self.unk)
            if len(self.cache) < CACHE_UNITS and len(unit) < 64:  # frequent units come early
                self.cache[unit] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, ids = self.cache.get, []
        for unit in self.units.findall(self.normalise(text)):
            more = get(unit) or self.unit_ids(unit)
            ids += more[1:] if ids and not self.byte_ids and ids[-1] == more[0] == self.unk else more
        return ids

    def decode(self, ids: list[int] | None) -> str:
        """The inverse transduction; bytes that form no character become U+FFFD."""
        text = b"".join(map(self.output.__getitem__, ids or [])).decode(errors="replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, ids, n_tokens, round_trip).

    ``ids`` are those of the model's own library, without begin or end tokens; ``round_trip`` says
    whether decoding them gives the text back (null: encoded as empty, compared with empty).
    Null and repeated ids give a row each; very long texts are encoded whole; an empty table gives an
    empty result; other columns are not read. A map over whole texts without a shuffle.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        alone("sp_fst", transducer.cache_clear)
        t = transducer(model)
        ids = [t.encode(x) for x in batch["text"]]
        return {"id": batch["id"], "ids": ids, "round_trip": [t.decode(i) == (x or "") for i, x in zip(ids, batch["text"], strict=True)]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_batches(own, run, "id long, ids array<int>, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: (id, text) decoded from ids; null or empty ids give the empty text."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        t = transducer(model)
        return {"id": batch["id"], "text": [t.decode(i) for i in batch["ids"]]}

    own = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_batches(own, run, "id long, text string").select(F.col("id").alias(id_col), "text")
