"""Edited passages near the least length, long sentences in the toxicity fit, lists and tables and named parts of articles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vinculo.llm import compact_windows, html_main, pii, sp_fst, token_counts, toxicity
from vinculo.llm.queries import vocabulary


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_edited_passages_near_the_least_length_are_found(spark):
    """Pairs of passages with edits, at Jaccard 0.8 or more, 40 other words around each; at least 0.9 of every kind get a row, through the whole operator."""
    rng = random.Random(12)
    kinds = {"50 verbatim": (50, []), "50, middle": (50, [25]), "50, anywhere": (50, [None]), "60, word 15": (60, [15]), "60, anywhere": (60, [None]), "80, anywhere": (80, [None]), "120, two": (120, [None, None])}
    rows, want, n = [], {}, 0
    word = lambda: f"w{rng.randrange(10**9)}"
    for kind, (length, edits) in kinds.items():
        for _ in range(60):
            a = [word() for _ in range(length)]
            b = list(a)
            for e in edits:
                b[rng.randrange(length) if e is None else e] = word()
            assert jaccard(a, b) >= 0.8
            for text in (a, b):
                rows.append((n, " ".join([word() for _ in range(40)] + text + [word() for _ in range(40)])))
                n += 1
            want[n - 1] = kind
    out = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id <> rep_id").collect()
    texts = dict(rows)
    for r in out:
        assert r.rep_id == r.doc_id - 1 and r.similarity >= 0.8 and r.n_words >= 50
        assert r.end_word <= len(texts[r.doc_id].split())
    got = {r.doc_id for r in out}
    share = {k: np.mean([i in got for i, q in want.items() if q == k]) for k in kinds}
    assert share["50 verbatim"] == 1.0 and min(share.values()) >= 0.9, share


def test_a_passage_beside_one_found_with_the_first_document(spark):
    """The smallest id shares one passage with two others, and a part too small for a passage of what these two share beside it."""
    rng = random.Random(21)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs, least = [], 3
    for f in range(150):
        passage, line = fill(54), fill(36)
        framed = fill(9) + line + fill(9)
        docs += [(least * f, fill(60) + passage + fill(9) + line + fill(80)), (least * f + 1, fill(60) + passage + framed + fill(60)), (least * f + 2, fill(60) + passage + framed + fill(60))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    reached = {}
    for r in compact_windows.repeated_passages(df).collect():
        assert r.doc_id // least == r.rep_id // least
        reached.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert [i for i, _ in docs if i % least == 2 and not set(range(60, 168)) <= reached.get(i, set())] == []


def test_what_linked_windows_share_beyond_the_first_document(spark):
    """The smallest id holds a passage; three others hold it with a few words more on either side, two of these with some more again: too few for a window of their own."""
    rng = random.Random(31)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs, want, size = [], {}, 5
    for f in range(60):
        passage, before, more, again = fill(60), fill(7), fill(7), fill(6)
        for i, words in enumerate((passage, before + passage + more, before + passage + more + again, before + passage + more + again, passage + more)):
            docs.append((size * f + i, fill(60) + words + fill(60)))
        want |= {size * f + 2: (60, 134, size * f + 1), size * f + 3: (60, 140, size * f + 2), size * f + 4: (60, 127, size * f + 1)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.start_word, r.end_word, r.rep_id) for r in compact_windows.repeated_passages(df).collect()}
    assert all(d // size == rep // size for d, _, _, rep in got)
    assert [i for i, (a, b, rep) in want.items() if (i, a, b, rep) not in got] == []


def test_words_said_over_and_over_do_not_meet_in_pairs(spark, monkeypatch):
    """A line of one word, too short in half of the documents, which hold longer lines of other words: no more pairs than a few a window, and lines long enough are found."""
    rng, pairs, plain = random.Random(41), [], compact_windows._rest_pairs
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]

    def counted(*args):
        out = plain(*args)
        pairs.append((args[0].count(), out.count()))
        return out

    monkeypatch.setattr(compact_windows, "_rest_pairs", counted)
    docs = [(i, fill(50) + (["for"] * 30 + [f"own{i}"] * 60 if i < 150 else ["for"] * 60) + fill(50)) for i in range(300)]
    got = {(r.doc_id, r.rep_id, r.start_word, r.end_word) for r in compact_windows.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()}
    assert {d for d, *_ in got} == set(range(150, 300)) and all((i, 150, 50, 110) in got for i in range(151, 300))
    assert all(n <= 20 * windows for windows, n in pairs), pairs


def test_stretches_are_the_best_of_the_least_width():
    rng = np.random.default_rng(3)
    for _ in range(300):
        shared = rng.random(rng.integers(5, 60)) < rng.choice([0.5, 0.8, 0.95])
        width = int(rng.integers(3, 20))
        got = list(compact_windows._stretches(shared, width, 80))
        score = lambda a, b: int(np.where(shared[a:b], 20, -80).sum())  # noqa: E731, B023
        best = max((score(a, b) for a in range(len(shared)) for b in range(a + width, len(shared) + 1)), default=-1)
        assert (not got and best < 0) or score(*got[0]) == best
        assert all(b - a >= width and score(a, b) >= 0 for a, b in got)
        ends = sorted(got)
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_sentences_end_at_all_marks_and_long_ones_are_cut_between_words():
    assert toxicity.sentences("你好。再见！好？") == ["你好。", "再见！", "好？"] and len(toxicity.sentences("你好。" * 300)) == 300
    text = " ".join(f"word{i}" for i in range(500))
    parts = toxicity.parts_of(text)
    assert max(map(len, parts)) <= toxicity.MAX_SENTENCE and set(text.split()) == {w for p in parts for w in p.split()}
    pairs = set(zip(text.split(), text.split()[1:], strict=False))
    assert pairs == {c for p in parts for c in toxicity.couples(p)}
    assert "".join(toxicity.parts_of("x" * 1500)) == "x" * 1500 and toxicity.parts_of(None) == []


def test_insults_late_in_a_long_sentence_are_learned(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(["river", "stone", "paper", "garden", "window", "music", "bread", "summer"]) for _ in range(n))
    docs = [(i, f"{plain(120)} scumbagger {plain(20)}" if i % 3 == 0 else plain(140), int(i % 3 == 0)) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.training_rows(table.select("doc_id", "text"), table.select("doc_id", "toxic")))
    probe = spark.createDataFrame([(1, "you scumbagger"), (2, plain(50))], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(probe, model).collect()}
    assert score[1] >= 0.5 > score[2]


def test_an_id_with_very_many_rows_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    rows = toxicity.training_rows(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")).collect()
    assert len(rows) <= 2 and len({r.h for r in rows}) == len(rows)


WORDS = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))


@pytest.mark.parametrize("learned", [False, True])
def test_tables_and_lists_inside_an_article_stay(learned):
    menu = "<nav><ul>" + "<li><a href=x>go</a></li>" * 40 + "</ul></nav>"
    page = f"{menu}<article><p>{WORDS(80, 'a')}</p></article><footer><p>foot</p></footer>"
    weights = html_main.learn([page] * 20) if learned else {}
    rows = "".join(f"<tr><td>r{i}</td><td>{i}</td></tr>" for i in range(200))
    items = "".join(f"<li><a href='/{i}'>item{i}</a></li>" for i in range(150))
    for middle, text in ((f"<table>{rows}</table>", " ".join(f"r{i} {i}" for i in range(200))), (f"<ul>{items}</ul>", " ".join(f"item{i}" for i in range(150)))):
        got = html_main.extract(f"{menu}<article><p>{WORDS(80, 'a')}</p>{middle}<p>{WORDS(80, 'b')}</p></article>", weights)
        assert got == f"{WORDS(80, 'a')} {text} {WORDS(80, 'b')}"


@pytest.mark.parametrize("part", ["<h2 id='discussion'>head</h2>", "<h2 id='related-work'>head</h2>", "<section id='legal'>head</section>", "<section class='search-engines'>head</section>", "<div class='ad-free'>head</div>"])
def test_names_that_only_hold_a_boilerplate_word_are_kept(part):
    assert html_main.extract(f"<article><p>{WORDS(40, 'a')}</p>{part}<p>{WORDS(40, 'b')}</p></article>", {}) == f"{WORDS(40, 'a')} head {WORDS(40, 'b')}"


@pytest.mark.parametrize("part", ["<div class='ad'>buy</div>", "<div class='site-header'>buy</div>", "<div class='comments-area'>buy</div>", "<div id='comments'>buy</div>", "<div class='cookie-notice'>buy</div>", "<aside>buy</aside>", "<div class='ad-slot left'>buy</div>"])
def test_boilerplate_names_are_dropped(part):
    assert html_main.extract(f"<article><p>{WORDS(40, 'a')}</p>{part}<p>{WORDS(40, 'b')}</p></article>", {}) == f"{WORDS(40, 'a')} {WORDS(40, 'b')}"


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        token_counts.WordCounter(vocabulary("byte_bpe_50k.json"))


def test_surrogates_of_rows_without_distinct_ids_stay_apart(spark):
    """Rows that share an id or have none, with colliding entities: each row's own text is rewritten, one entity the same everywhere."""
    mails = [f"user{i}@mail.example" for i in range(60)]
    rows = [(None if i % 2 else 7, f"{i}: {m} and {mails[0]}") for i, m in enumerate(mails)]
    df = spark.createDataFrame([(a, t, 1, 2) for a, t in rows], "doc_id long, text string, row int, moved int")
    out = pii.pseudonymise(df, b"k" * 32).collect()
    assert len(out) == 60 and all(m not in r.text for r in out for m in mails)
    parts = {int(r.text.split(":")[0]): r.text.split(": ")[1].split(" and ") for r in out}
    assert len({p[0] for p in parts.values()}) == 60 and {p[1] for p in parts.values()} == {parts[0][0]}


def test_a_worker_keeps_one_operators_memory(spark, monkeypatch):
    """What scores toxicity, or collects parts for the fit, lets go of the transducer and the units of an encoding before it in the same worker."""
    ran = []
    for module in (sp_fst, toxicity):
        monkeypatch.setattr(module, "map_batches", lambda df, fn, schema, real=module.map_batches: ran.append(fn) or real(df, fn, schema))
    docs = spark.createDataFrame([(1, "some plain words")], "doc_id long, text string")
    sp_fst.encode(docs, vocabulary("piece_bpe_32k.model"))
    toxicity.toxicity_scores(docs, toxicity.fit_model([("you zorgle here", 1)] * 20 + [("all is fine here", 0)] * 40))
    toxicity.fit(docs.selectExpr("doc_id AS h", "1 AS y", "text"))
    encode, *others = ran
    assert len(others) == 2
    for after, batch in zip(others, ({"id": [1], "text": ["plain"]}, {"h": [1], "y": [1], "text": ["plain"]}), strict=True):
        encode({"id": [1], "text": ["some plain words"]})
        assert sp_fst.transducer.cache_info().currsize == 1
        after(batch)
        assert sp_fst.transducer.cache_info().currsize == 0


def test_the_fit_from_arrow_parts_is_the_same():
    """Parts held as Arrow text give the model that lists of strings give, phrases too, and are no lists."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [([f"{word()} {word()} {'you zorgle' if y else 'we agree'} {word()}", f"{word()} é 中"], y) for y in [1] * 40 + [0] * 120]
    column = pa.array([p for p, _ in rows], pa.list_(pa.string()))
    plain = toxicity.fit_model(rows)
    lean = toxicity.fit_model([(toxicity.Parts(column.slice(3), i - 3) if i >= 3 else toxicity.Parts(column, i), y) for i, (_, y) in enumerate(rows)])
    assert plain.digest == lean.digest and (plain.slope, plain.shift) == (lean.slope, lean.shift)
