"""Text access and vectorised word hashing for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that one numpy pass takes; a longer text goes alone.
CHUNK_BYTES = 1 << 20
_SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_SEED))


_BYTE = randoms(256, 1)
_POWER = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWER if n <= len(_POWER) else np.cumprod(np.full(n, 0xD1342543DE82EF95, dtype=np.uint64))


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about CHUNK_BYTES together."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_BYTES:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def split_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, then the runs of bytes outside [\\x20\\x09-\\x0D]; null has none."""
    return text.encode().lower().split() if text else []


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all docs, and the offsets of the docs."""
    offsets = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) for d in docs], out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, dtype=np.uint64), offsets
    buf = np.frombuffer(b" ".join(b" ".join(d) for d in docs if d) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts + 1
    within = np.arange(len(buf)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE[buf] * _powers(int(lengths.max()))[within], starts)), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each doc the hashes of its k-word shingles in order; a shorter doc is one shingle."""
    n, out = len(words), []
    factor = randoms(k, 2) | np.uint64(1)
    if n >= k:
        rolled = sum((words[j : n - k + 1 + j] * factor[j] for j in range(k)), start=np.zeros(n - k + 1, dtype=np.uint64))
        rolled = mix(rolled)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= k:
            out.append(rolled[lo : hi - k + 1])
        elif hi > lo:
            out.append(mix(np.array([np.sum(words[lo:hi] * factor[: hi - lo]) + np.uint64(hi - lo)], dtype=np.uint64)))
        else:
            out.append(words[lo:lo])
    return out


def shingled(texts: list[str | None], k: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(index, words, shingle hashes) of each text, in memory bounded by CHUNK_BYTES or one text."""
    for lo, hi in runs([len(t or "") for t in texts]):
        docs = [split_words(t) for t in texts[lo:hi]]
        words, offsets = word_hashes(docs)
        for i, s in enumerate(shingle_hashes(words, offsets, k)):
            yield lo + i, docs[i], s


#: By operator, what empties its memory of earlier batches in this Python worker.
_memories: dict[str, Callable[[], None]] = {}


def alone(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Empty what other operators remember in this worker, and note how ``name`` is emptied: workers outlive stages, and memories would add up."""
    for other in _memories.keys() - {name}:
        _memories.pop(other)()
    _memories[name] = clear


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, budget: int = 8 << 20) -> DataFrame:
    """mapInArrow with columns as Python lists in and out, about ``budget`` bytes of input at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(spark_schema)
        for b in batches:
            for lo, hi in runs_of(b, budget):
                out = fn(b.slice(lo, hi - lo).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, spark_schema)


def runs_of(b: pa.RecordBatch, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``budget`` bytes each, so that Python objects stay few."""
    if not b.num_rows:
        return
    step = max(1, int(b.num_rows * budget / max(1, b.nbytes)))
    for lo in range(0, b.num_rows, step):
        yield lo, min(b.num_rows, lo + step)
