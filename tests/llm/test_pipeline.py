"""The corpus pipeline and its stages, against brute force and on awkward tables."""

import random

import pytest
import tiktoken
from test_text_operators import brute_passage, jaccard_oracle, windows_oracle, words

import corpus_pipeline
import public_tokenizers
from stipple.llm import bpe, decontam, language, substrings

SAY = {"en": "the cat sat on that mat with which other thing and because of where they were going", "de": "die katze saß auf dem tisch und schlief nicht weil sie noch nicht müde war heute"}


def corpus():
    """(documents, items): texts in two languages, copies, near copies, shared passages, leaks and junk."""
    rng = random.Random(21)
    prose = lambda n, lang="en": " ".join(f"{rng.choice(SAY[lang].split())}{rng.choice(['', '', 'x', 'y'])}{rng.randrange(40)}" for _ in range(n))
    rows = [(k, prose(rng.randrange(40, 120), lang), lang) for k, lang in ((k, ("en", "de")[k % 2]) for k in range(60))]
    for k in range(60, 70):  # copies and near copies
        ws = rows[k - 60][1].split()
        if k % 2:
            ws[rng.randrange(len(ws))] = "edited"
        rows.append((k, " ".join(ws), rows[k - 60][2]))
    passage = prose(50)
    rows += [(k, f"{prose(30)}  {passage}\n{prose(25)}", "en") for k in range(70, 75)] + [(75, passage, "en")]
    items = [(k, prose(24)) for k in range(5)]
    rows += [(80 + k, f"{prose(30)} {t.upper()}! {prose(10)}", "en") for k, t in items]
    rows += [(90, None, "en"), (91, "", "de"), (92, "12 34 56 !", "en"), (93, " \t ", None)]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    at = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, lang, f"src{i % 3}", len(t) if t else 0) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_the_pipeline_matches_brute_force(spark, folder):
    rows, items = corpus()
    left = [(i, t) for i, t, _ in rows if language.letters(t)]  # all of these are recognised
    least = {i: c for i, _, c in jaccard_oracle(left)}
    left = [(i, t) for i, t in left if least[i] == i]
    gone = {i: (n, k) for i, n, k, _ in windows_oracle(left)}
    seen = {}
    for _, t in left:
        ws = words(t)
        for a in range(len(ws) - substrings.WINDOW + 1):
            w = tuple(ws[a : a + substrings.WINDOW])
            seen[w] = seen.get(w, 0) + 1
    after = []
    for i, t in left:
        ws, cut = words(t), set()
        for a in range(len(ws) - substrings.WINDOW + 1):
            if seen[tuple(ws[a : a + substrings.WINDOW])] > 1:
                cut.update(range(a, a + substrings.WINDOW))
        assert gone[i] == (len(ws), len(cut))
        if len(cut) < len(ws):
            after.append((i, t if not cut else " ".join(w for k, w in enumerate(ws) if k not in cut)))
    asked = [decontam.normal_words(t) for _, t in items]
    after = [(i, t) for i, t in after if not any(brute_passage(x, decontam.normal_words(t)) <= decontam.allowed(len(x)) for x in asked)]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: own.encode_ordinary(t) for i, t in after}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == expected and len(got) == len(expected)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert 75 not in expected and not set(expected) & {80, 81, 82, 83, 84, 90, 91, 92, 93} and 30 < len(expected) < 75


STAGES = dict(corpus_pipeline.STAGES)
AWKWARD = "doc_id long, text string, lang string, source string, n_removed string, kept int, `a.b` string, sig long, `__key` long, page long, leaks string, declared string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns_of_awkward_tables(spark, folder, name):
    more = ("x", 5, "y", 7, None, 9, "none", "de")
    texts = [None, "", "  ", "12", "one", SAY["en"], SAY["en"], SAY["de"], SAY["en"] + " " + "the " * 3000]
    rows = [(i, t, (None, "en")[i % 2], None if i == 3 else "s", *more) for i, t in enumerate(texts)] + [(None, SAY["de"] + " noch", None, None, *(None for _ in more)), (6, SAY["en"], "en", "s", *more)]
    df = spark.createDataFrame(rows, AWKWARD)
    out = STAGES[name](spark, df, folder)
    assert out.columns == df.columns
    got = {tuple(r) for r in out.collect()}
    kept = {r[0] for r in got}
    if name == "substring_dedup":
        assert {r[:1] + r[2:] for r in got} <= {r[:1] + r[2:] for r in rows} and len(got) >= 8
    else:
        assert got <= set(rows)
    assert kept & {None, 7} if name == "near_duplicates" else {7, None} <= kept
    assert (name == "language_id") == (not kept & {0, 1, 2, 3})
    empty = STAGES[name](spark, df.limit(0), folder)
    assert empty.columns == df.columns and empty.count() == 0


def test_the_last_stage_on_an_awkward_table(spark, folder):
    df = spark.createDataFrame([(1, None, 2), (None, "", 2), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, ids int")
    got = STAGES["bpe"](spark, df, folder).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, 0), (3, 2), (3, 2)] and all(r["round_trip"] for r in got)
    assert STAGES["bpe"](spark, df.limit(0), folder).count() == 0
