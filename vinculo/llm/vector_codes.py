"""Vector codes: a codebook per part of a vector, trained by Lloyd rounds whose members stay with their entry's owner."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vinculo.functions.runtime import forget, materialize, small
from vinculo.llm.vectors import whole_vectors

#: Vectors for which an entry has one more owner: the most members that one owner holds of an entry that all share.
OWNER_VECTORS = 100_000
#: Members that wait in a task before they leave as blocks.
PENDING = 1 << 18
_CHUNK = 1 << 14
BLOCK = "position int, entry int, salt int, moved boolean, n int, members binary"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``, the lower index at ties; exact."""
    top = 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2
    if top >= 1 << 63:
        raise ValueError("components too large for exact distances")
    kind = np.float64 if top < 1 << 53 else np.int64  # doubles hold every whole number here, and multiply faster
    b, at, far = book.astype(kind), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms = (b * b).sum(1)
    for lo in range(0, len(x), _CHUNK):
        part = x[lo : lo + _CHUNK].astype(kind)
        d = norms - 2 * (part @ b.T)
        best = d.argmin(1)
        at[lo : lo + _CHUNK] = best
        far[lo : lo + _CHUNK] = d[np.arange(len(best)), best] + (part * part).sum(1)
    return at, far


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _out(rows: list[tuple[int, int, int, bool, np.ndarray]]) -> pa.RecordBatch:
    position, entry, salt, moved, members = zip(*rows, strict=True)
    data = [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), pa.array(moved), pa.array([len(m) for m in members], pa.int32()), pa.array([m.astype("<i4").tobytes() for m in members], pa.binary())]
    return pa.RecordBatch.from_arrays(data, names=["position", "entry", "salt", "moved", "n", "members"])


def _by_entry(position: int, entries: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(position, entry, members) for each entry that occurs."""
    order = np.argsort(entries, kind="stable")
    found, starts = np.unique(entries[order], return_index=True)
    for e, members in zip(found.tolist(), np.split(x[order], starts[1:]), strict=True):
        yield position, e, members


def _salted(rows: list[tuple[int, int, np.ndarray]], salt: int, moved: bool) -> pa.RecordBatch:
    return _out([(p, e, salt, moved, m) for p, e, m in rows])


def _owned(blocks: DataFrame) -> DataFrame:
    """Blocks moved to their owners and written."""
    return materialize(blocks.repartition("position", "entry", "salt"))


def _first_members(rows: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Every part of every vector with the owner of its nearest entry: the only shuffle of all parts."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        for b in batches:
            v = _matrix(b.column(0), parts * width)
            if len(v):
                salt += 1
                cut = ((p, v[:, p * width : (p + 1) * width]) for p in range(parts))
                yield _salted([r for p, x in cut for r in _by_entry(p, nearest(x, books[p])[0], x)], salt % salts, True)

    return _owned(rows.select("v").mapInArrow(run, BLOCK))


def _migrate(residents: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Members assigned anew where they are; those that keep their entry stay, the others go to the owner of their new one."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, waiting, leaving = TaskContext.get().partitionId(), 0, defaultdict(list)

        def leave() -> pa.RecordBatch:
            rows = [(p, e, np.concatenate(m)) for (p, e), m in leaving.items()]
            leaving.clear()
            return _salted(rows, salt % salts, True)

        for b in batches:
            stay = []
            for position, entry, own, members in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
                x = np.frombuffer(members, "<i4").reshape(-1, width).astype(np.int64)
                now = nearest(x, books[position])[0]
                if (same := now == entry).any():
                    stay.append((position, entry, own, False, x[same]))
                for p, e, m in _by_entry(position, now[~same], x[~same]) if not same.all() else ():
                    leaving[p, e].append(m)
                    waiting += len(m)
            if stay:
                yield _out(stay)
            if waiting > PENDING:
                yield leave()
                salt, waiting = salt + 1, 0
        if leaving:
            yield leave()

    judged = materialize(residents.mapInArrow(run, BLOCK), residents)
    return judged.where("not moved").unionByName(_owned(judged.where("moved")))


def _updated(residents: DataFrame, books: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each entry's members; owners sum their own, and at most one row an entry and task is shuffled."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for position, entry, members in zip(*(b.column(i).to_pylist() for i in (0, 1, 5)), strict=True):
                x = np.frombuffer(members, "<i4").reshape(-1, width)
                sums[position, entry] += x.sum(0, dtype=np.int64)
                counts[position, entry] += len(x)
        p, e = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])

    own = residents.mapInArrow(run, "position int, entry int, n long, sums array<long>")
    total = own.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in total.collect():  # at most one row an entry
        out[r.position, r.entry] = [s // r.n for s in r.sums]
    return out


def train(rows: DataFrame, books: np.ndarray, rounds: int, vectors: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` of Lloyd over ``rows(v)``, ``vectors`` of them, from ``books``.

    Blocks of members are partitioned by (position, entry, salt). In each round but the first, owners judge their resident
    members by the new entries and only members that change entry move. An entry that all vectors share has an owner for
    every OWNER_VECTORS of them. Entries that no part uses stay.
    """
    salts, residents = max(8, -(-vectors // OWNER_VECTORS)), None
    for _ in range(rounds):
        residents = _first_members(rows, books, salts) if residents is None else _migrate(residents, books, salts)
        books = _updated(residents, books)
    return books


def _coded(rows: DataFrame, books: np.ndarray, id_col: str) -> DataFrame:
    """(id, label, code, error) of ``rows(id, label, v)``."""
    parts, _, width = books.shape
    fields = [StructField(id_col, rows.schema["id"].dataType), StructField("label", rows.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, codes, errors = _matrix(b.column(2), parts * width), np.empty((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for p in range(parts):
                codes[:, p], far = nearest(v[:, p * width : (p + 1) * width], books[p])
                errors += far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=[id_col, "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, StructType(fields))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of each usable vector, the codebooks as parts x entries x width).

    Rows whose vector is null or holds null or non-finite components are dropped; components become floor(scale * x), and
    vectors are cut into ``parts`` equal parts. A position's codebook starts as that part of the ``entries`` smallest ids
    (at most 256; nulls last, ties by the vector; fewer vectors give fewer entries) and is trained by ``train`` on all
    vectors. ``code`` has two hex digits for each part in order: its nearest entry by squared distance, the lower index at
    ties; ``error`` is the sum of those distances. Codes are read off the vectors themselves with the final codebooks,
    which every task holds (parts x entries x width numbers), so no part is sent back to its vector.

    Length: the one of the smallest id whose length ``parts`` divides; usable vectors of any other length have code and
    error null and train nothing. Rows that repeat an id are vectors of their own; other columns are not read; an empty
    table gives an empty result. A scaled component of 2^26 or more is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = materialize(whole_vectors(vectors, scale, vector_col, id=id_col, label=label_col))
    by_id = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    lead = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*by_id).limit(1).collect()
    none = lambda df: df.select(F.col("id").alias(id_col), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not lead:
        return none(kept), np.zeros((parts, 0, 0), np.int64)
    dims = len(lead[0].v)
    rows = kept.where(F.size("v") == dims)
    first = np.array([r.v for r in rows.orderBy(*by_id).limit(entries).collect()], np.int64)  # at most 256 rows
    books = first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    books = train(rows, books, rounds, rows.count())
    coded = materialize(_coded(rows, books, id_col).unionByName(none(kept.where(F.size("v") != dims))))
    forget(kept)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: ``error`` summed over equal labels, null labels together."""
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(small(sums), coded["label"].eqNullSafe(sums["l"])).drop("l")


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components, by part, entry and position within the part, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
