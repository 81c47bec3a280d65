"""Operators over vectors, pages and conversations."""

import html as entities
import re

import numpy as np
import pytest

from stipple.llm import ann, html, transcripts


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "SAMPLE", 700)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 32))).astype(np.float32)
    x[700:760] = x[0]  # copies of a query: ties to the smaller ids
    rows = [(i, v.tolist(), "q", 1) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] + [1.0] * 31), (2004, [None] + [1.0] * 31), (2005, [float("inf")] * 32), (2006, [1.0] * 5), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows + [(*b, "q", 1) for b in bad], "vec_id long, embedding array<float>, query_id string, rank int")
    out = ann.nearest(df, df.filter("vec_id % 50 = 0 or vec_id is null"), 10).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 1500, 50))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        true = sorted((d[i], i) for i in range(1500) if i != q)[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in true})
    assert hits >= 0.95 * 10 * len(got)
    assert [i for _, _, i in sorted(got[0])] == list(range(700, 710))


def test_cells_part_the_space_and_are_left_out(monkeypatch):
    monkeypatch.setattr(ann, "CELL_SAMPLE", 4)
    rng = np.random.default_rng(3)
    centres = 60 * rng.standard_normal((16, ann.PROJECTED))
    points = centres[rng.integers(0, 16, 4000)] + rng.standard_normal((4000, ann.PROJECTED))
    cells = ann.Cells(points[:1000], 16)
    of = cells.of(points)
    assert len(cells.lows) == 16 and (points >= cells.lows[of]).all() and (points <= cells.highs[of]).all()
    assert np.bincount(of).max() < 4000 / 4
    visited = [cells.within(p, 17.0) for p in points[:200]]
    for p, near in zip(points[:200], visited, strict=True):  # no point within the distance is outside of these cells
        assert set(of[((points - p) ** 2).sum(1) <= 17.0].tolist()) <= set(near.tolist())
    assert np.mean([len(x) for x in visited]) < 5
    assert ann.Cells(np.zeros((50, ann.PROJECTED)), 8).of(points).max() == 0


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(df, df.filter("vec_id = 1"), 10).select("query_id", "rank", "vec_id", "score").collect()] == [(1, 1, 2, 1.0), (1, 2, 2, 1.0)]
    assert ann.nearest(df.limit(0), df, 10).count() == 0 and ann.nearest(df, df.limit(0), 10).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_articles_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = html.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<html><head><title>T</title></head><body class="page"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<div id="content"><article class="post"><h1>T&eacute;st &amp; more</h1><p>A <a href=x>link</a> &lt;b&gt;<br>line</p><form>f<input></form><div class="share-buttons">Share</div>
<p>End<script>if(a<b){}</script> of <!-- no <p> --> text<section class="comments"><article class="comment"><p>first!</p></article></section></article></div><aside>side</aside><footer>foot</footer>"""


def test_slots_beside_the_article():
    assert html.main_text(html.parse(PAGE)[0], html.Template(0, [])) == "Tést & more\n\nA link <b> line\n\nEnd of text"


@pytest.mark.parametrize("tokens, part", [(500_000, 5_000), (0, 3)])
def test_template_of_a_host_without_marks(spark, monkeypatch, tokens, part):
    monkeypatch.setattr(html, "BROADCAST_TOKENS", tokens)
    monkeypatch.setattr(html, "PART_PAGES", part)
    pages = [(k, f"http://h.example/{k}", f"<body><div><p>Welcome to our site</p></div><table><tr><td><a href=1>One</a> <a href=2>Two</a></td></tr></table><div><p>Story {k} tells of {k * 7} things.</p></div><div>All rights reserved</div></body>", "x") for k in range(8)]
    pages += [(100, None, None, "x"), (101, "", "", "x"), (None, "http://other.example", "<p>alone", "x"), (103, "nohost", "<" * 500 + " " + "a" * 5000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [got[k] for k in range(8)] == [f"Story {k} tells of {k * 7} things." for k in range(8)]
    assert got[100] == "" and got[101] == "" and got[None] == "alone" and got[103].endswith("a" * 5000)
    assert html.extract(df.limit(0)).count() == 0


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def test_template_inside_and_outside_the_article(spark):
    row = "<body><article><div><p>Read our special offer now</p></div><h1><a href=x>Title {0}</a></h1><p>Story {0} tells of it.</p><ul><li><a href=y>Related {0}</a></li></ul></article><div><p>By author {0}</p></div><div>Rights reserved</div></body>"
    got = texts(spark, [(k, "http://h.example/", row.format(f"no{k}")) for k in range(6)])
    assert got == {k: f"Title no{k}\n\nStory no{k} tells of it.\n\nBy author no{k}" for k in range(6)}


@pytest.mark.parametrize("tokens, most", [(500_000, 50_000), (0, 50_000), (0, 0)])
def test_template_by_distinct_pages_of_each_layout(spark, monkeypatch, tokens, most):
    monkeypatch.setattr(html, "BROADCAST_TOKENS", tokens)
    monkeypatch.setattr(html, "HOST_TOKENS", most)
    # copies aren't template, though their scripts differ
    rows = [(k, "http://c.example/", f"<body><script>t({k})</script><div><p>One story.</p><p>Its second paragraph.</p></div></body>") for k in range(3)]
    rows += [(3, "http://c.example/", "<body><div><p>Another.</p></div></body>"), (4, "http://c.example/", "<body><div><p>A third.</p></div></body>")]
    # three layouts on one nameless host, each on a third of the pages
    for a in range(3):
        rows += [(10 * (a + 1) + k, None, f"<body><div class=x{'abc'[a]}><p>Menu {a}</p><p>Terms {a}</p></div><table><tr><td>Own words {a} {k}</td></tr></table></body>") for k in range(5)]
    # near copies keep what they share
    rows += [(50 + k, "http://n.example/", f"<body><div><p>A long paragraph of the story.</p><p>And a further long one.</p><p>Edit {k}</p></div></body>") for k in range(4)]
    rows += [(60 + k, "http://n.example/", f"<body><div><p>Own text of page {k}</p></div></body>") for k in range(6)]
    got = texts(spark, rows)
    assert [got[k] for k in range(5)] == ["One story.\n\nIts second paragraph."] * 3 + ["Another.", "A third."]
    assert all(got[10 * (a + 1) + k] == f"Own words {a} {k}" for a in range(3) for k in range(5))
    assert all(got[50 + k] == f"A long paragraph of the story.\n\nAnd a further long one.\n\nEdit {k}" for k in range(4))


def test_marks_with_brackets_and_slashes(spark):
    row = "<body><div class='md:w-[50%] a/b[c'><ul><li><a href=1>One {0}</a></li><li><a href=2>Two</a></li></ul></div><div class='p-[2px'><p>Story {0} tells <a href=3>of</a> it.</p></div></body>"
    got = texts(spark, [(k, "http://h.example/", row.format(f"no{k}")) for k in range(6)])
    assert got == {k: f"Story no{k} tells of it." for k in range(6)}


def test_deep_and_long_pages():
    deep = "<div>" * 2000 + "<nav><a href=x>Menu</a></nav><article><p>Deep text.</p></article>" + "</div>" * 2000
    assert html.main_text(html.parse(deep)[0], html.Template(0, [])) == "Deep text."
    import time

    began = time.time()
    long = "<article><p>" + "<b>a</b> " * 100_000 + "</p></article>"
    assert html.main_text(html.parse(long)[0], html.Template(0, [])) == " ".join("a" * 100_000)
    nested = "<b>x " * 20_000 + "</i>" * 20_000 + "</b>" * 20_000
    assert html.main_text(html.parse(nested)[0], html.Template(0, [])) == " ".join("x" * 20_000)
    assert time.time() - began < 20


def test_hosts_of_few_pages_are_read_by_their_own_elements(spark):
    row = "<body><ul><li><a href=1>Menu one</a></li></ul><div><p>Story {0} tells of it.</p><p>All of it.</p></div></body>"
    got = texts(spark, [(k, f"http://h{n}.example/", row.format(k)) for n in (1, 2, 3) for k in range(10 * n, 10 * n + n)])
    assert got == {k: f"Story {k} tells of it.\n\nAll of it." for k in (10, 20, 21, 30, 31, 32)}


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    return transcripts.train(rows.selectExpr("conv_id conv", "turn", "role", "text"))


def test_marked_transcripts(spark, model):
    text = "System: be nice\n\nUser: hello?\nmore text\n\n**Assistant:** Hi <|there.\n- item: b\nHuman: thanks\nAI: ok"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, " \n\n ", 0), (None, "Q: why?\nA: so", 0), (5, "User: " + "x " * 30_000, 0)], "id long, transcript string, turn int")
    got = {}
    for r in transcripts.parse_transcripts(df, model).orderBy("turn").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"], r["rendered"]))
    assert [x[:2] for x in got[1]] == [("system", "be nice"), ("user", "hello?\nmore text"), ("assistant", "Hi <|there.\n- item: b"), ("user", "thanks"), ("assistant", "ok")]
    assert got[1][2][2] == "<|assistant|>\nHi <\\|there.\n- item: b\n<|end|>"
    assert [x[0] for x in got[None]] == ["user", "assistant"] and set(got) == {1, None, 5}
    assert transcripts.parse_transcripts(df.limit(0), model).count() == 0


def test_viterbi_against_all_paths(model):
    import itertools

    rows = [transcripts.features(x, p) for x, p in transcripts.lines_of("Hello there?\n\nIt is.\nYes\n\nWhy?")]
    best = max(itertools.product(range(6), repeat=len(rows)), key=lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(p)) + sum(model.scores(rows)[i, s] for i, s in enumerate(p)))
    assert model.viterbi(rows) == list(best)


def test_roles_of_held_out_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = transcripts.query(spark, "/root/testdata/sf0.01").filter("held_out").join(rows.select("conv_id", "turn", "role"), ["conv_id", "turn"]).select("role", "recovered").collect()
    assert len(got) > 50 and sum(r[0] == r[1] for r in got) > 0.9 * len(got)


def test_turns_of_held_out_conversations_are_found(spark):
    got = transcripts.query(spark, "/root/testdata/sf0.01").filter("held_out and n_lines > 0").collect()
    assert sum(r["n_turns"] == 1 for r in got) > 0.9 * len(got)


def test_long_conversations_as_on_one_page(spark, model):
    import random

    rng = random.Random(8)
    text = lambda: "\n".join(rng.choice(["", "\n"]) + "So " * rng.randrange(1, 40) + rng.choice("?.,") for _ in range(rng.randrange(0, 4)))
    rows = [(c, t, "user", text()) for c, n in ((1, 1500), (None, 700), (2, 3), (3, 1)) for t in range(n)]
    rows += [(4, None, None, text()) for _ in range(600)]  # no numbers at all
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    few = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, transcripts.recover_roles(df, model).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert got[0] == got[1] and len(got[0]) >= 2204
    # and as the whole transcript says
    whole = {t: [] for t in range(1500)}
    lines = [(t, x, p) for c, t, _, own in rows if c == 1 for x, p in [(x, (p if i else 1)) for i, (x, p) in enumerate(transcripts.lines_of(own))]]
    lines[0] = (lines[0][0], lines[0][1], 0)
    for (t, _, _), state in zip(lines, model.viterbi([transcripts.features(x, p) for _, x, p in lines]), strict=True):
        whole[t].append(state)
    found = {r["turn"]: r for r in transcripts.recover_roles(df, model).filter("conv_id = 1").collect()}
    assert all(found[t]["n_turns"] == sum(x % 2 == 0 for x in s) and found[t]["recovered"] == (transcripts.ROLES[s[0] // 2] if s else None) for t, s in whole.items())


def test_awkward_conversations(spark, model):
    rows = [(1, t, "user", "What is it then? " * 10 if t % 2 == 0 else "It is so. " * 100, "y") for t in range(11)]
    rows += [(2, 0, None, None, "y"), (2, 0, None, None, "y"), (3, None, "odd", "", "y"), (None, 1, "user", "a\nb", "y"), (4, 0, "user", "same turn", "y"), (4, 0, "user", "another", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, recovered string")
    got = transcripts.recover_roles(df, model).collect()
    assert len(got) == 11 + 1 + 1 + 1 + 2
    assert [r["recovered"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["turn"])][:4] == ["user", "assistant", "user", "assistant"]
    assert all((r["recovered"] is None) == (r["n_lines"] == 0) for r in got)
    assert transcripts.recover_roles(df.limit(0), model).count() == 0
