"""Packing, vector codes and centroid clustering against plain versions, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from vinculo.llm import centroids, packing, vector_codes
from vinculo.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
WORDS = "word_bpe_49k.json"


def check_pieces(pieces, ids_of, length=4096):
    """Each id of each document lies in one piece, sequences are gapless and all but the last are full."""
    whole, used = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        whole[p.doc_id, p.doc_tokens].append(p)
        used[p.sequence_id].append(p)
    for key, own in whole.items():
        own.sort(key=lambda p: p.start)
        n = len(own) and key[1]
        copies = sum(p.start == 0 for p in own)
        if copies == 1:
            assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) == n
            got = b"".join(bytes(p.ids) for p in own)
            assert got == ids_of(key[0])
    assert sorted(used) == list(range(len(used)))
    for s, own in used.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        total = sum(p.length for p in own)
        assert total == length if s < len(used) - 1 else 0 < total <= length


def library(texts):
    t = Tokenizer.from_file(vocabulary(WORDS))
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, x in texts.items()}


def test_packing_query_equals_the_library(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())
    want = library(texts)
    rows = QUERIES["op11_packing"](spark, SF).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(i, len(b) // 4) for i, b in want.items()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), vocabulary(WORDS))
    check_pieces(pieces.collect(), want.__getitem__)


@pytest.mark.parametrize("name", [WORDS, "byte_bpe_50k.json"])
def test_packing_edges(spark, name):
    odd = "A\x1cb É é x <|endoftext|>y <|startoftext|> ΣΑΣ İ don't 12ab ½ 你好。 👍🏽\x85z"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, odd), (5, "one"), (5, "one"), (None, "one"), (6, "word " * 30000), (7, "x" * 30000), (8, "́ ́a \x1f q")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, n int, part int").repartition(3)
    t = Tokenizer.from_file(vocabulary(name))
    want = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, x in rows}
    pieces = packing.pack(df, vocabulary(name), length=512).collect()
    check_pieces(pieces, want.__getitem__, 512)
    assert sum(p.length for p in pieces) == sum(len(want[i]) // 4 for i, _ in rows)
    assert packing.pack(df.where("false"), vocabulary(name)).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(i, "one two " * (i % 5)) for i in range(300)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(df, vocabulary(WORDS), length=64)
    out = sorted(packing.sequences(pieces, 64).collect(), key=lambda r: r.sequence_id)
    assert all(r.n_tokens == 64 and r.padding == 0 for r in out[:-1])
    last = out[-1].n_tokens
    assert out[-1].padding == (0 if last & (last - 1) == 0 else 64 - last)
    assert sum(len(r.ids) for r in out) == 4 * sum(r.n_tokens for r in out)
    starts = [(p.sequence_id, p.offset) for p in pieces.collect()]
    assert sorted(starts) == [(r.sequence_id, s) for r in out for s in r.starts]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, [math.floor(256 * x) for x in v], label) for i, v, label in usable(rows))
    width = len(kept[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v, _ in kept[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((d(x, c), n) for n, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                own[near(x, books[p])[1]].append(x)
            for n, xs in own.items():
                books[p][n] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, labels = {}, collections.Counter()
    for i, v, label in kept:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{n:02x}" for _, n in found), sum(e for e, _ in found), label)
        labels[label] += out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (code, error, labels[label], digest) for i, (code, error, label) in out.items()}


def brute_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in usable(rows) if len(v) == dims]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, xs in own.items():
            cents[n] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    per = collections.Counter()
    for _, far, n in out:
        per[n] += far
    return sorted((i, n, far, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, far, n in out)


def table(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, v int, id int, position int, cluster int"
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    return duckdb.sql(f"SELECT vec_id, embedding, label FROM read_parquet('{SF}/embeddings.parquet')").fetchall()


@pytest.fixture(scope="module")
def odd():
    """Few different values, so ties abound; half of the rows are one vector; nulls, non-finite values and null labels."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.choice([-0.5, 0.25, 1.0, 3.3]))) for _ in range(64)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(1000 + i, rows[3][1], 7) for i in range(120)]
    bad = [None, [None] * 64, [float("nan")] + [0.0] * 63, [0.0] * 63 + [float("-inf")], [0.0] * 63 + [None]]
    return rows + [(5000 + i, v, 1) for i, v in enumerate(bad)]


def test_vector_codes_query_equals_brute_force(spark, vectors):
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op12_vector_codes"](spark, SF).collect()}
    assert got == brute_codes(vectors)


def test_vector_codes_with_ties_hot_vectors_and_gaps(spark, odd):
    for rounds in (0, 1, 4):
        coded, books = vector_codes.compress(table(spark, odd), rounds=rounds)
        digest = vector_codes.codebooks_sha256(books)
        got = {r.vec_id: (r.code, r.error, r.label_error, digest) for r in vector_codes.with_label_error(coded).collect()}
        assert got == brute_codes(odd, rounds=rounds)


def test_vector_codes_lengths_repeats_and_empty_tables(spark):
    rows = [(3, [1.0] * 32, 1), (3, [1.0] * 32, 1), (4, [2.0] * 32, None), (1, [1.0] * 31, 1), (2, [], None), (None, [5.0] * 32, None)]
    coded, books = vector_codes.compress(table(spark, rows))
    got = collections.Counter((r.vec_id, r.code, r.error) for r in coded.collect())
    assert books.shape == (16, 4, 2) and got == {(3, "00" * 16, 0): 2, (4, "02" * 16, 0): 1, (None, "03" * 16, 0): 1, (1, None, None): 1, (2, None, None): 1}
    for none in (table(spark, rows).where("false"), table(spark, [(1, None, 1)]), table(spark, [(1, [1.0], 1)])):
        coded, books = vector_codes.compress(none)
        assert coded.where("code is not null").count() == 0 and books.size == 0
        assert vector_codes.with_label_error(coded).count() == coded.count()


def test_only_members_that_change_entry_move(spark, vectors):
    """The blocks of a migration that are marked as moved hold the members whose entry differs, no others."""
    v = np.array([[math.floor(256 * x) for x in r[1]] for r in vectors], np.int64)
    rows = spark.createDataFrame([(x,) for x in v.tolist()], "v array<long>").repartition(3)
    books = v[:8].reshape(8, 16, 4).transpose(1, 0, 2)
    residents = vector_codes._first_members(rows, books, 3)
    after = vector_codes._updated(residents, books)
    moved = collections.Counter()
    for r in vector_codes._migrate(residents, after, 3).collect():
        moved[r.moved] += r.n
    parts = [v[:, 4 * p : 4 * p + 4] for p in range(16)]
    want = sum(int((vector_codes.nearest(x, books[p])[0] != vector_codes.nearest(x, after[p])[0]).sum()) for p, x in enumerate(parts))
    assert moved[True] == want and moved[True] + moved[False] == 16 * len(v)


def test_large_components_stay_exact():
    x, book = np.array([[2**25, 0], [2**25 - 1, 1]]), np.array([[2**25 - 1, 0], [2**25, 0]])
    at, far = vector_codes.nearest(x, book)
    assert at.tolist() == [1, 0] and far.tolist() == [0, 1]


def test_centroids_query_equals_brute_force(spark, vectors):
    got = QUERIES["op13_centroids"](spark, SF).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(vectors)


def test_centroids_with_ties_hot_vectors_and_gaps(spark, odd):
    more = odd + [(7000, [1.0] * 63, 1), (7001, [], 1), (7, odd[8][1], 1)]
    for k, rounds in ((3, 2), (300, 1)):
        found, cents = centroids.cluster(table(spark, more), k=k, rounds=rounds)
        got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.with_inertia(found, cents).collect())
        assert got == brute_clusters(more, k, rounds)


def test_centroids_of_nothing(spark, odd):
    for none in (table(spark, odd).where("false"), table(spark, [(1, None, 1), (2, [1.0], 1)])):
        found, cents = centroids.cluster(none)
        assert cents == [] and centroids.with_inertia(found, cents).count() == 0
    found, _ = centroids.cluster(table(spark, [(None, [1.0] * 64, 1), (None, [1.0] * 64, 1)]))
    assert [tuple(r) for r in found.collect()] == [(None, 0, 0)] * 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="scaled component"):
        centroids.cluster(table(spark, [(1, [1e30] * 64, 1)]))
