"""Token counts by the whole-token shortcut, for a lower-casing word BPE."""

from __future__ import annotations

import functools
import json
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.arcs import PieceArcs
from vinculo.llm.texts import map_batches

#: Remembered words per Python worker.
CACHE_WORDS = 500_000
#: Stands for the end of a word within strings of byte symbols.
LAST = "\ue000"
#: White space of the tokenizer's pattern engine (fixed values).
SPACE = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCounter:
    """Counts tokens of a vocabulary file with the special-token, lower-case and word-end rules of its kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if not self.end or "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError(f"{path}: only lower-casing vocabularies with word ends are counted")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        mark = lambda p: p.removesuffix(self.end) + LAST if self.end and p.endswith(self.end) else p
        self.ranks = {(a, mark(b)): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        back = {c: b for b, c in enumerate(self.symbols)}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        strings = {p.removesuffix(self.end) + LAST if self.end and p.endswith(self.end) else p for p in model["vocab"]}
        self.paths = PieceArcs(strings, self.merged, max(map(len, strings)), free_characters=False)
        self.known: set[str] = set()
        for string in strings:
            if string[-1] == LAST and len(string) > 1 and len(self.merged(string)) == 1:  # the proof that it is one token alone
                try:
                    self.known.add(bytes(back[c] for c in string[:-1]).decode())
                except (UnicodeDecodeError, KeyError):
                    continue
        self.cache: dict[str, int] = {}

    def merged(self, string: str) -> list[str]:
        """The merge rules applied to a string of byte symbols; LAST marks the word's end."""
        parts = [*string[:-2], string[-2:]] if string[-1] == LAST else list(string)
        ranks = self.ranks
        while len(parts) > 1:
            best, pair = len(ranks), None
            for p in zip(parts, parts[1:], strict=False):
                if (r := ranks.get(p, best)) < best:
                    best, pair = r, p
            if pair is None:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def rest(self, word: str) -> int:
        """Tokens of a pre-token that is not known as one token."""
        found = self.cache.get(word)
        if found is None:
            string = word if word.isascii() and word.isalnum() else "".join(self.symbols[b] for b in word.encode())
            found = len(self.paths.path(string + LAST))
            if len(self.cache) < CACHE_WORDS and len(word) < 64:  # frequent words come early
                self.cache[word] = found
        return found

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        parts = self.special.split(text)
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form
            words = WORD.findall(part.lower())
            more = [w for w in words if w not in self.known]
            total += len(words) - len(more) + sum(map(self.rest, more))
        return total + len(parts) - 1


@functools.lru_cache(2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit) under the vocabulary file.

    A pre-token that is in the vocabulary and provably encodes alone as one token counts at once;
    the proof runs the merges on every vocabulary string when a worker starts. Only other
    pre-tokens are merged (as the sequence of tokens whose neighbours the merges leave apart), and
    each worker remembers a bounded number of results. Special tokens that
    occur in a text count as one token each. Null text has 0 bytes and 0 tokens; repeated ids give
    a row each; an empty table gives an empty result; other columns are not read. No shuffle.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        tokens = counter(vocabulary).tokens
        return {"id": batch["id"], "n_bytes": [len(t.encode()) if t else 0 for t in batch["text"]], "n_tokens": [tokens(t) for t in batch["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(own, run, "id long, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
