"""Every operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from vinculo.llm import block_names, compact_windows, decontam, html_main, minhash, pii, sharding, sp_fst, texts, token_counts, toxicity
from vinculo.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, blanks, a very long text, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 5000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "one  two"), (7, "one\ttwo"), (8, long), (9, long + " "), (10, long + " tail"), (11, "x" * 300000)]
    return spark.createDataFrame([(i, t, "q", 1, 2, 3) for i, t in rows], "doc_id long, text string, id string, name int, key int, `n` int")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("doc_id < 0")


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, documents, k, percent):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    copies = [(100000 + i, " ".join(w if rng.random() > 0.012 else f"v{rng.randrange(9999)}" for w in base)) for i in range(60)]
    rows = documents + copies
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(edge, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(edge, k=3, percent=85).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == got[5] == (1, 4) and got[6] == got[7] == (1, 6)
    assert got[8][1] == got[9][1] == got[10][1] == 8
    assert minhash.near_duplicates(edge).count() == edge.count() and minhash.near_duplicates(empty).count() == 0
    assert set(minhash.drop_near_duplicates(edge).columns) == set(edge.columns)


def test_exact_duplicates_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES["op9_exact_duplicates"]).fetchall()
    got = QUERIES["op9_exact_duplicates"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_exact_duplicates_edges(spark, edge, empty, block):
    rows = edge if block == 1024 else edge.where("length(text) < 100 or text is null")
    got = collections.defaultdict(list)
    for r in block_names.exact_duplicates(rows, block_bytes=block).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 2, True)] and got[2] == [(1, 2, False)] and got[3] == [(3, 1, True)]
    assert got[4] == [(4, 3, True)] and got[5] == [(4, 3, False)] * 2 and got[7] == [(6, 2, False)]
    assert block_names.exact_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in block_names.drop_exact_duplicates(rows).where("doc_id < 8").collect()) == [1, 3, 4, 6]


def test_block_digest_is_of_the_normalised_text(edge):
    got = {r.doc_id: r.text_sha256 for r in block_names.exact_duplicates(edge).collect()}
    assert got[7] == hashlib.sha256(b"one two").hexdigest() and got[1] == hashlib.sha256(b"").hexdigest()


def test_lpt_equals_the_heap_step_by_step():
    rng = random.Random(2)
    classes = [(rng.randrange(1, 500), 0, rng.randrange(1, 60)) for _ in range(40)]
    classes = [(s, 0, n) for s, n in dict((c[0], c[2]) for c in classes).items()]
    loads, counts = [0] * 7, collections.Counter()
    for s, _, n in sorted(classes, reverse=True):
        for _ in range(n):
            j = min(range(7), key=lambda j: (loads[j], j))
            loads[j] += s
    mine = [0] * 7
    for s, _, j, first, last in sharding.lpt(classes, 7):
        mine[j] += s * (last - first + 1)
        counts[s] += last - first + 1
    assert sorted(mine) == sorted(loads) and counts == {s: n for s, _, n in classes}


def test_shards(spark, documents, edge, empty):
    rows = spark.createDataFrame(documents, "doc_id long, text string")
    got = sharding.lpt_shards(rows, 24).collect()
    text = dict(documents)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in documents}
    shard_of, loads, slots = {}, collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard and r.grown_shard is None and r.law == "bytes"
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for i, t in documents:
        groups[t] += len((t or "").encode()) + 8
    heap = [0] * 24
    for g in sorted(groups.values(), reverse=True):
        heap[heap.index(min(heap))] += g
    assert sorted(heap) == sorted(loads[s] for s in range(24))
    assert sharding.lpt_shards(edge, 3).count() == edge.count() and sharding.lpt_shards(empty, 3).count() == 0


def test_token_counts_equal_the_library(spark, documents, edge, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["don't I'LL we've 12345 ½ x²", "a<|endoftext|>b <|startoftext|>", "İstanbul ẞ é é ñ\x00\x01 \x1c x", "Σας ΟΔΟΣ 日本 हिन्दी ﬁ ① ٣٤ ___ a_b", "<|endoftext|>", "🙂🙂 a🙂b"]
    rows = documents + [(10**6 + i, x) for i, x in enumerate(odd)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    text = dict(rows)
    assert all(r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False)) and r.n_bytes == len(text[r.doc_id].encode()) for r in got)
    assert {(r.n_tokens, r.over_limit) for r in token_counts.token_counts(edge.where("doc_id < 3"), path).collect()} == {(0, False)}
    assert token_counts.token_counts(empty, path).count() == 0


def test_sentencepiece_equals_the_library(spark, documents, edge, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "   a  b", "x\n\ny\t z", "日本語 αβγ", "🙂🙂 a🙂b", "▁a ▁", "हिन्दी में", "aaaaaaaaaaaaaaaaaaaaaaa", "....!!!!----", "http://x.y/z?q=1"]
    rows = documents + [(10**6 + i, x) for i, x in enumerate(odd)]
    got = sp_fst.encode(spark.createDataFrame(rows, "doc_id long, text string"), path)
    text = dict(rows)
    for r in got.collect():
        assert r.ids == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.round_trip or "▁" in text[r.doc_id]
    back = {r.doc_id: r.text for r in sp_fst.decode(got, path).collect()}
    assert all(back[i] == lib.decode(lib.encode(t)) for i, t in rows)
    assert {r.n_tokens for r in sp_fst.encode(edge.where("doc_id < 3"), path).collect()} == {0} and sp_fst.encode(empty, path).count() == 0


def brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for j, text in items:
        w = words(text)
        k = min(5, len(w))
        want = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else {}
        for i, t in docs:
            d = words(t)
            s = [tuple(d[a : a + k]) for a in range(len(d) - k + 1)]
            n = sum(want.values())
            if w and not want.keys().isdisjoint(s):
                for a in range(-n, len(s)):
                    have = collections.Counter(s[max(0, a) : max(0, a + n)])
                    common = sum((have & want).values())
                    if 100 * common >= 80 * (sum(have.values()) + n - common):
                        out.add((i, j))
                        break
    return out


def test_leaks_equal_brute_force(spark, documents, edge, empty):
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    base = items[0][1].split()
    more = [(10**6, "before " + items[3][1] + " after"), (10**6 + 1, " ".join(base[:-1])), (10**6 + 2, " ".join(base[: len(base) // 2])), (10**6 + 3, items[1][1].upper())]
    items = items + [(900, "two words"), (901, None), (902, "")]
    docs = documents + more
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == brute_leaks(docs, items)
    assert decontam.contaminated(empty, b).count() == 0 and decontam.contaminated(edge, b.where("item_id < 0")).count() == 0
    assert decontam.drop_contaminated(edge, b).count() == edge.count()


def test_leaks_by_join_when_the_benchmark_is_large(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    want = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontam, "LITERAL_SET", 10)
    monkeypatch.setattr(decontam, "INDEX_CELLS", 10)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == want


def test_compact_windows_equal_a_plain_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, width in ((300, 10), (500, 46), (40, 46)):
        v = rng.permutation(n).astype(np.uint64) + np.uint64(1)
        v[[n // 3, 2 * n // 3]] = 0
        want = set()
        for c in range(n):
            if v[c]:
                a = c
                while a > 0 and v[a - 1] > v[c]:
                    a -= 1
                b = c
                while b + 1 < n and v[b + 1] > v[c]:
                    b += 1
                if b - a + 1 >= width:
                    want.add((c, a, b))
        assert set(zip(*map(list, compact_windows.compact_windows(v, width)), strict=True)) == want


def test_repeated_passages(spark, edge, empty):
    rng = random.Random(3)
    word = lambda: f"u{rng.randrange(10**6)}"
    passage = [word() for _ in range(70)]
    near = list(passage)
    near[40] = "changed"
    short = [word() for _ in range(45)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [(1, fill(100) + passage + fill(30)), (2, fill(10) + passage + fill(200)), (3, fill(60) + near + fill(5)), (4, fill(300)), (5, fill(20) + short + fill(50)), (6, short + fill(80)), (7, passage)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = compact_windows.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 7} and {r.rep_id for r in got} == {1}
    spans = {r.doc_id: (r.start_word, r.end_word) for r in got}
    assert spans[1][0] <= 100 and spans[1][1] >= 165 and spans[2] == (10, 80) and spans[7] == (0, 70)
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    assert compact_windows.repeated_passages(empty).count() == 0
    assert {r.doc_id for r in compact_windows.repeated_passages(edge).collect()} == {8, 9, 10}


def test_repeated_passages_of_families_equal_brute_force(spark):
    """The smallest id under a key holds a variant that is too different, a shared line elsewhere, or the passage at its second place."""
    rng = random.Random(6)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], {}
    for f in range(40):
        at, passage, line = 10 * f, fill(54), fill(12)
        varied = list(passage)
        for i in (9, 26, 43):
            varied[i] = "changed"
        framed = fill(21) + line + fill(21)
        docs += [(at, fill(60) + varied + fill(60)), (at + 1, fill(60) + passage + fill(60)), (at + 2, fill(60) + passage + fill(60))]
        docs += [(at + 3, fill(60) + line + fill(80)), (at + 4, fill(60) + line + fill(80) + framed + fill(60)), (at + 5, fill(60) + framed + fill(60))]
        want |= {at + 1: (60, 114), at + 2: (60, 114), at + 4: (152, 206), at + 5: (60, 114)}
    for i, words in docs:  # by brute force: the documents that share 46 or more shingles in a row with another
        others = [set(zip(*(w[j:] for j in range(5)), strict=False)) for n, w in docs if n != i and n // 10 == i // 10]
        runs = [[s in o for s in zip(*(words[j:] for j in range(5)), strict=False)] for o in others]
        assert (i in want) == any("1" * 46 in "".join(map(str, map(int, r))) for r in runs)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word) for r in compact_windows.repeated_passages(df).collect()}
    assert got == {(i, *span) for i, span in want.items()}


def test_pairs_of_the_rest_share_enough(spark):
    """Many windows around one line: those with a passage in common are found after the rounds, the others do not meet."""
    rng = random.Random(7)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    line, twins = fill(12), [fill(30) for _ in range(10)]
    docs = [(i, fill(30) + line + fill(30)) for i in range(60)] + [(100 + i, fill(10) + twins[i // 2] + line + twins[i // 2][::-1] + fill(10)) for i in range(20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.rep_id, r.start_word, r.end_word) for r in compact_windows.repeated_passages(df).collect()}
    assert got == {(100 + i, 100 + i - i % 2, 10, 82) for i in range(20)}


def test_every_passage_of_a_pair(spark):
    rng = random.Random(8)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    one, two, three = fill(60), fill(80), fill(90)
    near = three[:44] + ["changed"] + three[45:]
    repeated = three[:8]
    docs = [(1, one + fill(70) + two), (2, one + fill(70) + two), (3, three + fill(90) + repeated + fill(90)), (4, near + fill(90) + repeated + fill(90)), (5, fill(5) + two + fill(40) + two)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word, r.rep_id) for r in compact_windows.repeated_passages(df).collect()}
    assert {(1, 0, 60, 1), (1, 130, 210, 1), (2, 0, 60, 1), (2, 130, 210, 1), (3, 0, 90, 3), (4, 0, 90, 3), (5, 5, 85, 1), (5, 125, 205, 1)} <= got


def test_surrogates(spark, edge, empty):
    text = 'Mr. John Smith and Mrs SMITH wrote to ann.b1@mail7.example.com from 10.1.2.3, +1 (323) 555-9830, card 4111111111111111; token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B". Herr Иван Петров.'
    again = "ANN.B1@MAIL7.EXAMPLE.COM!! 4111 1111 1111 1111, Mr John Smith"
    df = spark.createDataFrame([(1, text), (2, again), (3, "nothing here 1.0"), (4, None), (4, "")], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in pii.pseudonymise(df, b"k").collect():
        got[r.doc_id].append((r.text, r.n_entities))
    (one, n), (two, m) = got[1][0], got[2][0]
    assert n == 8 and m == 3 and got[3] == [("nothing here 1.0", 0)] and set(got[4]) == {(None, 0), ("", 0)}
    for secret in ("John", "Smith", "SMITH", "ann.b1", "10.1.2.3", "555-9830", "4111111111111111", "9233A8EC", "Петров"):
        assert secret not in one
    found1, found2 = pii.find(one), pii.find(two)
    assert [k for _, _, k, _ in found1] == [k for _, _, k, _ in pii.find(text)]
    assert {c for _, _, k, c in found2 if k == "email"} == {c for _, _, k, c in found1 if k == "email"}
    card = next(c for _, _, k, c in found1 if k == "card")
    assert pii._luhn(card) == 0 and card in {c for _, _, _, c in found2} and re.search(r"\d{4} \d{4} \d{4} \d{4}", two)
    given = re.match(r"Mr\. (\w+) \w+", one)[1]
    assert given in pii.GIVEN["latin", "m"] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and pii.script_of(re.search(r"Herr (\w+)", one)[1]) == "cyrillic"
    assert pii.pseudonymise(empty, b"k").count() == 0 and pii.pseudonymise(edge, b"k").count() == edge.count()


def test_surrogates_stay_distinct(spark, monkeypatch):
    plain = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, c, attempt=0: plain(key, kind, c, attempt))
    rows = spark.createDataFrame([("email", f"{a}@x.org") for a in "abcdefghijklmnopqrstuvwxyz"] + [("person-m", f"n{i}") for i in range(3000)], "kind string, canonical string")
    got = pii.collision_free(rows, b"k").collect()
    assert len(got) == 3026 and len({(r.kind, r.surrogate) for r in got}) == 3026
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.canonical) for r in got}


def test_surrogates_of_persons(spark):
    """Whole names, scripts without case, mentions without a title, and one family name under all titles."""
    texts = [
        "Mr John Fitzgerald Kennedy met Dr. J. van Dyke. Later Kennedy and John Fitzgerald Kennedy left, and John's hat stayed. The dyke broke.",
        "Mr Kennedy, Dr. Kennedy and Mrs Kennedy; MR KENNEDY", "Mr 田中 and Dr محمد and Prof כהן met. 田中 spoke.", "Dr. Anna Brown or Ms Anna Brown",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, b"k").collect()}
    for name in ("Kennedy", "KENNEDY", "John", "Fitzgerald", "Dyke", "田中", "محمد", "כהן", "Anna", "Brown"):
        assert not any(name in t for t in got.values()), name
    m = re.fullmatch(r"Mr ((\w+) \w+ (\w+)) met Dr\. .*\. Later (\w+) and (\w+ \w+ \w+) left, and (\w+)'s hat stayed\. The dyke broke\.", got[0])
    assert m[3] == m[4] and m[1] == m[5] and m[2] == m[6]
    assert got[1] == f"Mr {m[3]}, Dr. {m[3]} and Mrs {m[3]}; MR {m[3].upper()}"
    assert pii.script_of(got[2][3:]) == "han" and re.fullmatch(r"Mr (\S+) and Dr \S+ and Prof \S+ met\. \1 spoke\.", got[2])
    assert len(set(re.fullmatch(r"Dr\. \w+ (\w+) or Ms \w+ (\w+)", got[3]).groups())) == 1


def test_surrogates_of_persons_stay_distinct(spark):
    rows = [(f"person-{'mfn'[i % 3]}", f"n{i}") for i in range(6000)] + [(f"person-{'mf'[i % 2]}", f"g{i} n0") for i in range(150)]
    got = pii.collision_free(spark.createDataFrame(rows, "kind string, canonical string"), b"k").collect()
    assert len(got) == 6150 and len({r.surrogate for r in got}) == 6150
    assert {r.surrogate.split()[-1] for r in got if r.canonical.endswith(" n0")} == {r.surrogate for r in got if r.canonical == "n0"}
    assert all(r.surrogate == pii.surrogate(b"k", r.kind, r.canonical, r.attempt) for r in got)


def test_main_text(spark):
    import html

    rows = duckdb.sql(f"SELECT page_id, html FROM read_parquet('{SF}/pages.parquet')").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op3_main_text"](spark, SF).collect()}
    for i, page in rows:
        article = re.sub(r"</?(?:p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", article))).strip()
        assert got[i] == (want, len(want))


def test_main_text_edges(spark):
    page = """<html><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies and other things</div><div class="sidebar"><p>Other words here</p></div>
    <div class='content'><h2>Title &amp; more</h2><p>Hello <b>wor</b>ld, this is the <a href=x>linked</a> text of a  long
    paragraph.</p><p>Second one &#233;t&eacute; &lt;x&gt;</p></div><div class='comments'><p>I disagree with this, my friend</p></div><footer>c</footer></body></html>"""
    rows = [(1, "u", page, "z"), (2, "u", None, "z"), (3, None, "", "z"), (4, "u", "<script>only", "z"), (4, "u", "plain words alone", "z"), (None, "u", "<p>a<p>b", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_main.main_text(df).collect()]
    want = "Title & more Hello world, this is the linked text of a long paragraph. Second one été <x>"
    assert sorted(got, key=str) == sorted([(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0), (4, "plain words alone", 17), (None, "a b", 3)], key=str)
    assert html_main.main_text(df.where("page_id = 99")).count() == 0


@pytest.mark.parametrize("boiler", ["<div class='advert'><p>{}</p></div>", "<form><p>{}</p><input><input></form>", "<aside><ul><li><a href=x>{}</a></li><li>more</li></ul></aside>"])
def test_main_text_around_boilerplate_without_article(boiler):
    learned = html_main.learn(["<nav><p>" + "a " * 90 + "</p></nav><div class=advert><p>" + "buy " * 900 + "</p></div><article><p>" + "word " * 900 + "</p></article>"] * 20)
    short, long = " ".join(f"s{i}" for i in range(40)), " ".join(f"l{i}" for i in range(400))
    noise = boiler.format(" ".join(f"x{i}" for i in range(250)))
    for weights in ({}, learned):
        for one, two in ((short, long), (long, short), (short, short)):
            page = f"<html><body><div><div><p>{one}</p>{noise}<p>{two}</p></div></div></body></html>"
            assert html_main.extract(page, weights) == f"{one} {two}"


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM read_parquet('{sf}/labels.parquet')").fetchall())
    rows = [(truth[r.doc_id], r.predicted, r.score) for r in QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(t == p for t, p, _ in rows) / len(rows) > 0.95  # some labels are noise
    assert sum(p for t, p, _ in rows if t) / sum(t for t, _, _ in rows) > 0.75
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, p, s in rows)


def test_toxicity_edges(spark, edge, empty):
    none = toxicity.fit_model([])
    got = toxicity.toxicity_scores(edge, none).collect()
    assert len(got) == edge.count() and all(r.predicted == 0 for r in got)
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice("the of and to bird tree cloud river stone walk talk green blue".split()) for _ in range(12))
    model = toxicity.fit_model([(clean() + " moron", 1) for _ in range(40)] + [(clean(), 0) for _ in range(200)])
    tests = ["the moron walks", "a mo-ron", "m o r o n talks", "mooron", "the green river", None, ""]
    df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity_scores(df, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 0, 0, 0]
    assert toxicity.toxicity_scores(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(edge, labels).count() == edge.count()


def test_hashing_of_chunks_does_not_depend_on_neighbours():
    docs = ["a b c d e f", "", None, "x", "a b c d e f g", "é  ñ\tA b"]
    whole = {i: s.tolist() for i, _, s in texts.shingled(docs, 3)}
    for i, d in enumerate(docs):
        assert [s.tolist() for _, _, s in texts.shingled([d], 3)] == [whole[i]]
    assert whole[0] == whole[4][:4] and len(whole[5]) == 2


def test_rows_are_told_apart_when_ids_are_null_or_repeat(spark):
    """Of equal texts one row stays, whatever the ids; rows of one id are judged each by its own text."""
    items = [(1, "the quick brown fox jumps over the lazy dog again and again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, "alone of its kind", 1), (1, "a twin", 2), (2, "a twin", 3), (3, "q", 4), (3, "q", 5), (2, "a", 6), (4, "a", 7), (None, "q", 8), (None, items[0][1], 9), (5, items[0][1] + " x", 10), (5, "another", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for drop, more in ((block_names.drop_exact_duplicates, [9]), (minhash.drop_near_duplicates, [])):
        left = sorted(r.n for r in drop(df).collect())
        assert len({4, 5}.intersection(left)) == 1 and sorted({*left} - {4, 5}) == sorted([1, 2, 6, 10, 11, *more])
    exact = sorted((r.doc_id or 99, r.keep_id or 99, r.group_size, r.kept) for r in block_names.exact_duplicates(df).collect())
    assert exact == sorted([(99, 99, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (3, 3, 3, False), (2, 2, 2, True), (4, 2, 2, False), (99, 3, 3, False), (99, 99, 1, True), (5, 5, 1, True), (5, 5, 1, True)])
    near = sorted((r.doc_id or 99, r.component_id or 99, r.kept) for r in minhash.near_duplicates(df).collect())
    assert near.count((3, 3, True)) == 1 and near.count((3, 3, False)) == 1 and near.count((99, 3, False)) == 1
    for literal in (decontam.LITERAL_SET, 0):
        kept, decontam.LITERAL_SET = decontam.LITERAL_SET, literal
        try:
            assert sorted((r.doc_id or 99, r.item_id) for r in decontam.contaminated(df, bench).collect()) == [(5, 1), (99, 1)]
            assert sorted(r.n for r in decontam.drop_contaminated(df, bench).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 11]
        finally:
            decontam.LITERAL_SET = kept
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(80)] + [(101, 0)], "doc_id long, toxic int")
    more = [(100 + i, "a moron walks" if i % 2 else f"word{i % 7} walks", 100 + i) for i in range(80)]
    toxic = spark.createDataFrame([(None, "you moron", 1), (None, "you bird", 2), (1, "moron moron", 3), (1, "bird", 4), *more], "doc_id long, text string, n int")
    assert sorted(r.n for r in toxicity.drop_toxic(toxic, labels).collect()) == [2, 4, *range(100, 180, 2)]


def test_repeated_passages_of_rows_without_distinct_ids(spark):
    rng = random.Random(9)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fill(60)
    rows = [(None, fill(10) + passage), (7, passage + fill(10)), (7, fill(80)), (8, fill(80))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word, r.rep_id) for r in compact_windows.repeated_passages(df).collect()}
    assert got == {(None, 10, 70, 7), (7, 0, 60, 7)}


def test_leaks_with_edits_equal_brute_force(spark):
    """Edited passages, at begin, end and inside of documents, down to the least similarity: 0.99 of them are found, and nothing else."""
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    rng = random.Random(1)
    fill = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    docs = []
    for i in range(300):
        w = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randrange(3)):
            w[rng.choice([0, 1, 2, -1, -2, rng.randrange(len(w))])] = "changed"
        t = " ".join(w[rng.randrange(4) if rng.random() < 0.3 else 0 :])
        docs.append((i, rng.choice([t, f"{fill(20)} {t} {fill(9)}", f"{t} {fill(30)}", f"{fill(30)} {t}"])))
    want = brute_leaks(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_fingerprints_of_short_and_of_very_long_windows(spark):
    """The packed bit counts give the same bits as counting one bit at a time."""
    rng = random.Random(2)
    wins = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 40, 32768)]
    got = [r.fp for r in decontam.fingerprinted(spark.createDataFrame([(i, w) for i, w in enumerate(wins)], "i int, win array<long>")).orderBy("i").collect()]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w) > len(w)) for w in wins]
    assert [g % 2**64 for g in got] == want


def test_kernel_equals_a_plain_sum():
    import itertools as it

    def plain(a, b):
        def vector(w):
            w, out = f"<{w}>", collections.Counter()
            for i, j, k in it.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
            return out

        x, y = vector(a), vector(b)
        dot = lambda p, q: sum(v * q[s] for s, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["moron", "mooron", "mroon", "idiot", "a", "the moron", "banana"]
    # gaps of 0 to 3 characters inside the span count by DECAY, as in the packed form
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain(a, b)) < 1e-4, (a, b)


def test_toxicity_of_phrases(spark):
    """A phrase of two words that are both common in clean documents, also with inserted letters."""
    rng = random.Random(5)
    words = "the of and to bird tree cloud river stone walk talk green blue kill yourself help time".split()
    clean = lambda: " ".join(rng.choice(words) for _ in range(12)).replace("kill yourself", "kill time")
    model = toxicity.fit_model([(f"{clean()} kill yourself {clean()}", 1) for _ in range(60)] + [(clean(), 0) for _ in range(300)])
    tests = ["go kill yourself now", "kiill yourself", "kill time", "help yourself", "kill the bird yourself", "kill. yourself", "the bird tree", None]
    df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity_scores(df, model).orderBy("doc_id").collect()] == [1, 1, 0, 0, 0, 0, 0, 0]


def test_surrogates_of_small_spaces(spark):
    """More entities than surrogates of their length: all stay distinct, and none equals an entity."""
    rows = [("phone", f"{i:03d}") for i in range(100, 1000)] + [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(0, 256, 4)]
    got = pii.collision_free(spark.createDataFrame(rows, "kind string, canonical string"), b"k").collect()
    assert len(got) == len(rows) and len({(r.kind, r.surrogate) for r in got}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    assert pii.rendered("phone", "+1 2 3", "45678") == "+4 5 678"


def test_surrogates_of_rows_without_id(spark):
    """Entities that a collision moved are moved in rows without an id as well."""
    rows = [(None, f"call +{i // 100} {i // 10 % 10} {i % 10} now") for i in range(100, 1000)]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()]
    phones = [re.sub(r"\D", "", t) for t in got]
    assert len(got) == 900 and all(p and t.startswith("call +") for p, t in zip(phones, got, strict=True))
    if all(len(re.findall(r"\d", t)) == 3 for _, t in rows):
        found = [pii.find(t) for _, t in rows]
        assert not all(found) or len(set(phones)) == 900


def test_main_text_keeps_articles_titles_and_offsets():
    words = "w " * 60
    inner = f"<article><header><h1>My title</h1></header><p>{words}</p></article>"
    want = f"My title {words.strip()}"
    for page in (f"<div class='layout no-sidebar'>{inner}</div>", f"<div class='has-header wrapper'><div class=sidebar><p>{words}</p></div>{inner}</div>", f"<div class='site header'>{inner}</div>"):
        assert html_main.extract(page, {}) == want
    assert html_main.extract(f"<p>{'İ ' * 30}</p><script>var x</script><p>after {words}</p>", {}) == f"{'İ ' * 30}after {words.strip()}"
    assert html_main.extract("<b>x " * 50000, {}).count("x") == 50000


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [[-rng.random() * 3 for _ in range(rng.randrange(3))] + [rng.choice([0.0, rng.random() * 4])] for _ in range(rng.randrange(1, 12))]
        flat = [(x, i) for i, parts in enumerate(scores) for x in parts]
        ends = [j for j, (_, i) in enumerate(flat, 1) if j == len(flat) or flat[j][1] != i]
        want = max([0.0] + [sum(x for x, _ in flat[a:b]) for a in range(len(flat)) for b in ends if b > a])
        first, last = html_main.best_run(scores)
        whole = sum(sum(p) for p in scores[first + 1 : last]) + (max(sum(scores[first][a:]) for a in range(len(scores[first]))) if last > first else 0.0)
        assert abs(whole - want) < 1e-9


@pytest.mark.parametrize("kind,rule,fallback,squeeze", [("unigram", "nmt_nfkc", True, True), ("unigram", "nmt_nfkc_cf", False, True), ("unigram", None, True, False), ("bpe", "nmt_nfkc", False, True), ("bpe", None, True, False)])
def test_transducers_of_other_models_equal_the_library(kind, rule, fallback, squeeze):
    """Hand-made models of both kinds, with and without normaliser and byte fallback."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    rng = random.Random(7)
    m = model_pb2.ModelProto()
    m.trainer_spec.model_type = {"unigram": 1, "bpe": 2}[kind]
    m.trainer_spec.byte_fallback = fallback
    if rule:
        m.normalizer_spec.ParseFromString(model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec.SerializeToString())
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, squeeze
    for piece, t in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=t)
    if fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    letters = list("abcde▁é.1")
    strings = list(letters)
    while len(strings) < 90:  # every piece is two pieces joined, as merges make them
        x = rng.choice(strings) + rng.choice(strings)
        if x not in strings and "▁" not in x[1:] and len(x) < 8:
            strings.append(x)
    for i, x in enumerate(strings):
        m.pieces.add(piece=x, score=-float(i) if kind == "bpe" else -rng.random() * 3 * len(x), type=1)
    blob = m.SerializeToString()
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=blob), sp_fst.PieceTransducer(blob)
    texts_ = ["", " ", "a", "  ab  cd ", "ABC ﬁ ① ½ é", "日本 a", "xyz", "e\u0301 \u3000a", "a\tb\n c"] + ["".join(rng.choice("abcdeé.1  zA") for _ in range(rng.randrange(40))) for _ in range(400)]
    for t in texts_:
        assert mine.encode(t) == lib.encode(t), (t, mine.normalise(t))
