"""Packing by concatenate and cut: token totals of partitions, prefix sums, fixed windows."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.prefix import before_parts
from vinculo.functions.runtime import materialize, small
from vinculo.llm.texts import runs_of
from vinculo.llm.token_counts import SPACE, WORD, byte_symbols

#: Entries of one generation of a worker's remembered words, and their greatest length.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Characters that ``str.split`` takes for white space and the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(f"[{SPACE}]+")


class _Remembered(dict):
    """Results of ``make`` by word. When a generation is full it becomes the old one, from which words that still occur return."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, as the library gives them.

    A vocabulary with word ends drops white space and never merges across it, so there texts are taken word by word. Words
    are remembered, and so are their pre-tokens, which are fewer; the library's merges serve a pre-token that is not. Texts of any
    other vocabulary go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
        self.library = Tokenizer.from_file(path)
        self.merge, self.symbols = self.library.model.tokenize, byte_symbols()
        self.library.no_padding()
        self.library.no_truncation()
        self.pre_tokens = _Remembered(self._pre_token)
        self.words = _Remembered(self._word)

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pre_token(self, text: str) -> bytes:
        symbols = text if text.isascii() and text.isalnum() else "".join(self.symbols[b] for b in text.encode())
        return np.array([t.id for t in self.merge(symbols)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return self.pre_tokens[word] if word.isalpha() else b"".join(map(self.pre_tokens.__getitem__, WORD.findall(word)))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or self.special(text):
            return self._encode(text)
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final form
        if not unicodedata.is_normalized("NFC", low):
            return self._encode(text)
        words = filter(None, _SPACE.split(low)) if _SEPARATORS.search(low) else low.split()
        return b"".join(map(self.words.__getitem__, words))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_rows(docs: DataFrame, vocabulary: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(id, ids, n, part, before): the token ids of each document and ``end``; ``before`` counts the tokens ahead of it in its partition."""
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary).ids
        for b in batches:
            for lo, hi in runs_of(b, 8 << 20):
                ids = [encode(t) + closing for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(before)], names=["id", "ids", "n", "part", "before"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, ids binary, n long, part long, before long")


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: (id, start, length, ids, doc_tokens, sequence_id, offset).

    All documents, each closed by the id ``end``, are one stream that is cut every ``length`` ids, so only the last
    sequence has room left. First pass: each partition writes its documents' ids and where they begin in it. Prefix sums
    over the partitions' totals then give every document its place in the stream. Second pass: a document is cut at the
    multiples of ``length`` that it crosses; the pieces beside a cut carry its boundary: ``start`` in the document,
    ``offset`` in the sequence. ``ids`` are little-endian unsigned 32-bit numbers. The stream's order is that of the input's
    partitions. No row is shuffled; the driver sees nothing.

    Null and empty text is ``end`` alone; rows that repeat an id, or have none, are documents of their own; a text of any
    length is one row's ids; other columns are not read; an empty table gives an empty result.
    """
    rows = materialize(token_rows(docs, vocabulary, end, id_col, text_col))
    parts = before_parts(rows.groupBy("part").agg(F.sum("n").alias("total")), "part", "total").select("part", F.col("before").alias("base"))
    at, upto = F.col("base") + F.col("before"), F.col("base") + F.col("before") + F.col("n")
    placed = rows.join(small(parts), "part").select("id", "ids", "n", at.alias("at"), upto.alias("upto"))

    def piece(s):
        low, high = F.greatest("at", s * length), F.least("upto", (s + 1) * length)
        start, n = low - F.col("at"), high - low
        return F.struct(start.alias("start"), n.alias("length"), F.substring("ids", (start * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"), s.alias("sequence_id"), (low - s * length).alias("offset"))

    crossed = F.sequence(F.expr(f"at div {length}"), F.expr(f"(upto - 1) div {length}"))
    cut = placed.select("id", "n", F.transform(crossed, piece).alias("pieces")).select("id", F.col("n").alias("doc_tokens"), F.inline("pieces"))
    return cut.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, length: int = 4096) -> DataFrame:
    """(sequence_id, ids, n_tokens, starts, padding): the packed sequences of ``pack``.

    ``starts`` are the offsets at which pieces begin. A sequence is padded to ``length`` unless its tokens are a power of two.
    """
    by = F.array_sort(F.collect_list(F.struct("offset", F.col("length").alias("n"), "ids")))
    rows = pieces.groupBy("sequence_id").agg(by.alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), "n_tokens", F.col("p")["offset"].alias("starts"), F.when(F.bit_count("n_tokens") == 1, 0).otherwise(length - F.col("n_tokens")).alias("padding"))
