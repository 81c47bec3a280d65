"""Operators over documents, against brute force on awkward texts."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

import public_tokenizers
from stipple.llm import bpe, components, ctw, decontam, jaccard, language, sharding, substrings

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def awkward():
    """(doc_id, text): nulls, blanks, repeated rows, copies, near copies, shared passages, periodic and long texts."""
    base, passage = prose(120), prose(50)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  ONE"), (None, prose(60)), (None, None), (7, base), (8, base), (8, base), (9, base.upper())]
    for k in range(10, 22):
        ws = base.split()
        for _ in range(k % 4 + 1):
            ws[RNG.randrange(len(ws))] = "edited"
        rows.append((k, " ".join(ws)))
    rows += [(k, f"{prose(30)} {passage} {prose(k)}") for k in range(30, 36)]
    rows += [(40, "the " * 300), (41, prose(34)), (42, "the " * 35), (43, "x" * 20_000), (44, prose(20_000)), (45, "a\x00b   c\x1dd é\U0001f600 " * 20)]
    rows += [(k, prose(RNG.randrange(1, 200))) for k in range(50, 80)]
    return rows


ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    # further columns, some named as outputs and internal columns are
    rows = [(i, t, "en", "src", 5, "shard?", 7, "kept?") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, shard string, key long, kept string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def windows_oracle(rows, size=substrings.WINDOW):
    ws = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    out = Counter()
    for (i, _), w in zip(rows, ws, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group, grams, passages", [(20_000, 4_000_000, 4_000_000), (3, 0, 0)])
def test_substrings_match_brute_force(docs, monkeypatch, group, grams, passages):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "BROADCAST_GRAMS", grams)
    monkeypatch.setattr(substrings, "BROADCAST_PASSAGES", passages)
    out = substrings.dedup_substrings(docs, outputs=("kept_sha256", "kept_text")).select("kept.doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == windows_oracle(ROWS)


@pytest.mark.parametrize("patterns, words_, bits", [(20_000, 200_000, 2), (7, 50, 64), (3, 10**6, 1)])
def test_automata_locate_what_hashes_only_confirm(monkeypatch, patterns, words_, bits):
    monkeypatch.setattr(substrings, "PATTERNS", patterns)
    monkeypatch.setattr(substrings, "WORDS", words_)
    monkeypatch.setattr(substrings, "WINDOW", 5)
    whole = substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda w, n: whole(w, n) & np.uint64((1 << bits) - 1))  # many collide
    rng = random.Random(5)
    shard, expected, number = substrings.Shard(), set(), 0
    for g in range(12):
        group = [(number + k, 7, rng.randrange(50), " ".join(f"{rng.choice("ab")}{g}" for _ in range(rng.randrange(5, 14))).encode()) for k in range(rng.randrange(1, 6))]
        number += len(group)
        shard.add(group, False)
        seen = Counter(tuple(t.split()[i : i + 5]) for *_, t in group for i in range(len(t.split()) - 4))
        expected |= {(k, s + i + j) for k, _, s, t in group for i in range(len(t.split()) - 4) if seen[tuple(t.split()[i : i + 5])] > 1 for j in range(5)}
    shard.flush()
    got = {(r["key"], x) for b in shard.out for r in b.to_pylist() for x in range(r["start"], r["stop"])}
    assert got == expected and expected


def jaccard_oracle(rows):
    sets = []
    for _, t in rows:
        w = [x.encode().lower() for x in words(t)]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("told, part, rows", [(8192, 50_000, 500_000), (8192, 3, 0), (0, 50_000, 500_000)])
def test_jaccard_matches_brute_force(docs, monkeypatch, told, part, rows):
    monkeypatch.setattr(jaccard, "TOLD", max(told, 1))
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows)
    assert rows_of(jaccard.join_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_oracle(ROWS)


def test_jaccard_keeps_one_of_each_group(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    expected = jaccard_oracle(ROWS)
    want = {c for i, n, c in expected if n} | {i for i, n, _ in expected if not n}
    assert set(ids) == want and ids.count(7) == 1 and 8 not in ids


def test_adaptive_prefix_never_misses_a_link():
    rng = np.random.default_rng(1)
    hot = rng.integers(1, 1 << 60, 40, dtype=np.uint64)
    order = jaccard.Order(hot, rng.integers(5, 9000, 40))
    asks = set()
    for _ in range(400):
        n = int(rng.integers(1, 80))
        s = np.unique(np.concatenate([rng.choice(hot, min(40, n // 2), replace=False), rng.integers(1, 1 << 60, n - n // 2, dtype=np.uint64)]))
        drop = int(len(s) * rng.random() * 0.2)
        t = np.sort(rng.permutation(s)[drop:])
        both = len(np.intersect1d(s, t))
        if 100 * both >= 80 * (len(s) + len(t) - both):
            (ps, _, a), (pt, _, b) = order.prefix(s), order.prefix(t)
            k = min(a, b)
            cut = lambda p, x: p[: len(x) - jaccard.least_overlap(len(x)) + k]
            assert len(np.intersect1d(cut(ps, s), cut(pt, t))) >= k
            asks.add(k)
    assert len(asks) > 1


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 20)] + [(3, 3), (None, 4)]
    out = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 20)}}


def test_bpe_is_tiktokens(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.bpe(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256", "exact", "ids", "decoded"))
    expected = Counter()
    for i, t in ROWS:
        ids = own.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True] += 1
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact") == expected


def test_bpe_of_very_long_pretokens():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("ab" * 20_000, "a" * 30_001, "".join(RNG.choice("etaoin") for _ in range(20_000))):
        assert bpe.merge(text.encode(), ranks) == own.encode_ordinary(text)


def plain_bpe(piece, ranks):
    """The lowest rank first, of equal ones the leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_where_a_merge_makes_a_pair_of_lower_rank():
    rng = random.Random(11)
    for _ in range(200):
        tokens = sorted({bytes([x]) for x in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(30)})
        rng.shuffle(tokens)
        ranks = {t: 37 * i for i, t in enumerate(tokens)}
        for _ in range(30):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
            assert bpe.merge(piece, ranks) == ([ranks[piece]] if piece in ranks else plain_bpe(piece, ranks))


def test_bpe_with_a_full_cache(docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    small, own = bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _, t in ROWS[:40]:
        assert np.frombuffer(small.encode(t), np.uint32).tolist() == own.encode_ordinary(t or "")


def test_sharding_is_exact_and_uniform(spark, docs):
    out = sharding.shuffle_into_shards(docs, 5)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r[0], r[1]) for r in rows) == Counter(ROWS)
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    big = sharding.shuffle_into_shards(spark.range(40_000), 4).collect()
    parts = np.array([[sum(1 for r in big if r["id"] // 10_000 == a and r["shard"] == b) for b in range(4)] for a in range(4)])
    assert (parts.sum(0) == 10_000).all() and abs(parts - 2500).max() < 250


def test_sharding_with_any_names_and_one_exchange_of_rows(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("id `__key`", "if(id % 3 = 0, null, 'x') `__n`", "id % 2 `__r`", "id part", "id place", "id second", "id kept", "array(id) `a.b`", "id shard")
    out = sharding.shuffle_into_shards(df, 3)
    rows = out.collect()
    assert out.columns == ["__key", "__n", "__r", "part", "place", "second", "kept", "a.b", "shard", "slot"]
    assert sorted(r["__key"] for r in rows) == list(range(3000)) and all(r["kept"] == r["__key"] == r["a.b"][0] for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(3) for k in range(1000)]
    plan = sharding.shuffle_into_shards(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 3  # the rows, once; the other two move counts
    # each source partition's rows are spread over the shards as drawn, and neighbours part
    slots = {r["__key"]: (r["shard"], r["slot"]) for r in rows}
    assert abs(np.corrcoef([slots[k][1] for k in range(3000)], range(3000))[0, 1]) < 0.08
    assert abs(sum(slots[k][0] == slots[k + 1][0] for k in range(2999)) / 2999 - 1 / 3) < 0.05


def test_sharding_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_EACH", 50)
    monkeypatch.setattr(sharding, "MATRIX", 12)
    rows = sharding.shuffle_into_shards(spark.range(0, 2001, 1, 9), 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(500 + (s == 0))]


def test_hypergeometric_draws():
    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6.0) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    m = sharding.matrix([10, 0, 33, 7], 6, 1)
    assert [sum(r) for r in m] == [10, 0, 33, 7] and sorted(map(sum, zip(*m, strict=True))) == [8, 8, 8, 8, 9, 9]


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_word_scores_match_brute_force(docs, monkeypatch, head):
    monkeypatch.setattr(ctw, "HEAD", head)
    rows = ROWS
    tokens = [[w.encode().lower() for w in words(t)] + [None] for _, t in rows]
    out_of = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(x for ws, h in zip(tokens, out_of, strict=True) if not h for x in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter((i, h, len(ws), sum(counts[x] > 0 for x in ws), total, round(sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in ws), 4)) for (i, _), ws, h in zip(rows, tokens, out_of, strict=True))
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in ctw.score(docs).collect())
    assert got == expected


def tree_oracle(train, text):
    """Context-tree weighting by its definition: recursive, over dictionaries."""
    counts = Counter()

    def visit(data, see):
        data = b"\0" * ctw.DEPTH + data
        for i in range(ctw.DEPTH, len(data)):
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                see([(data[i - d : i], node) for d in range(ctw.DEPTH + 1)], bit)

    children = {}

    def learn(path, bit):
        for d, s in enumerate(path):
            counts[s, bit] += 1
            if d < ctw.DEPTH:
                children.setdefault(s, set()).add(path[d + 1])

    for t in train:
        visit(t, learn)
    block = lambda s: float(ctw.kt_block(np.array([float(counts[s, 0])]), np.array([float(counts[s, 1])]))[0])
    memo = {}

    def weighted(s):
        if s not in memo:
            memo[s] = block(s) if len(s[0]) == ctw.DEPTH else np.logaddexp(block(s), sum(weighted(c) for c in children.get(s, ()))) - np.log(2)
        return memo[s]

    total = 0.0

    def predict(path, bit):
        nonlocal total
        p = 0.5
        for s in reversed(path):
            own = 1.0 if len(s[0]) == ctw.DEPTH else np.exp(block(s) - np.log(2) - weighted(s))
            p = own * (counts[s, bit] + 0.5) / (counts[s, 0] + counts[s, 1] + 1) + (1 - own) * p
        total += np.log10(p)

    visit(text, predict)
    return total


@pytest.mark.parametrize("piece", [8_000_000, 300])
def test_byte_scores_match_the_definition(spark, monkeypatch, piece):
    monkeypatch.setattr(ctw, "SLICE", piece)
    monkeypatch.setattr(ctw, "CHUNK", piece // 6)
    rows = [(i, RNG.choice(["abab cabba", "naïve é", "xyz\x00\x00", "", "the cat sat on the mat"]) * RNG.randrange(1, 5)) for i in range(40)]
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["score"] == pytest.approx(tree_oracle(train, dict(rows)[r["doc_id"]].encode()), abs=1e-6)


def test_log_gamma():
    import math

    x = np.array([0.5, 1, 1.5, 7.5, 8, 100.5, 1e7])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_language_fuses_what_is_there(spark):
    said = {"en": "the cat sat on the mat with that other thing", "fr": "le chat était sur la table avec des choses", "de": "die katze saß auf dem tisch und schlief nicht"}
    rows = []
    for k in range(300):
        lang = ("en", "fr", "de")[k % 3]
        ws = said[lang].split()
        RNG.shuffle(ws)
        host = {"en": "a.example.com", "fr": "b.exemple.fr", "de": "c.beispiel.de"}[lang]
        rows.append((k, " ".join(ws), "xx-bad!" if k % 50 == 0 else lang.upper() + "-XX", f"https://{host}/p{k}"))
    rows += [(900, None, "en", None), (901, "12 34 !", "fr", "u"), (902, "le", None, "https://b.exemple.fr/"), (903, "", None, None), (None, said["de"], None, None), (905, said["en"] * 3000, None, "//x")]
    df = spark.createDataFrame(rows, "id long, body string, markup string, url string")
    out = {r["kept"]["id"]: r for r in language.identify(df, ("id",), "body", "markup", "url", None).collect()}
    assert len(out) == len(rows)
    assert all(out[k]["detected"] == ("en", "fr", "de")[k % 3] for k in range(300))
    assert [out[k]["rejected"] for k in (900, 901, 903)] == [True] * 3 and out[902]["detected"] == "fr"
    assert out[None]["detected"] == "de" and out[905]["detected"] == "en"
    assert language.identify(df.limit(0), ("id",), "body", "markup", "url", None).count() == 0


def test_language_of_documents_that_were_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    src = language._source(docs, "text", "lang", None, "source", ("doc_id",))
    model = language.train(src.filter("kept.doc_id % 3 != 0"))
    rest = src.filter("kept.doc_id % 3 = 0").select("text", "declared").collect()
    told = [(d, model.langs[int(model(t).argmax())]) for t, d in rest if d and language.letters(t)]
    assert len(told) > 200 and sum(a == b for a, b in told) > 0.97 * len(told)


@pytest.mark.parametrize("hosts", [100_000, 1])
def test_language_fusion_matches_brute_force(spark, monkeypatch, hosts):
    monkeypatch.setattr(language, "BROADCAST_HOSTS", hosts)
    rng = random.Random(12)
    say = {"en": "the cat sat on the mat with that other thing", "fr": "le chat était sur la table avec des choses", "de": "die katze saß auf dem tisch und schlief nicht"}
    rows = []
    for k in range(120):
        lang = rng.choice(list(say))
        text = " ".join(rng.sample(say[lang].split(), rng.randrange(1, 6)))
        url = rng.choice([f"http://{rng.choice('ab')}.x.{lang}/", "http://c.y.org/", "nodots", None])
        rows.append((k, rng.choice([text] * 9 + [None, "12"]), rng.choice([lang, lang, "en", None]), url))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    src = language._source(df, "text", "lang", "url", None, ("doc_id", ))
    model = language.train(src)
    facts = [(r["kept"]["doc_id"], r["text"], r["declared"], r["host"], r["domain"], r["suffix"]) for r in src.collect()]
    spoken = [f for f in facts if language.letters(f[1])]
    verdict = {f[0]: model.langs[int(model(f[1]).argmax())] for f in spoken}

    def share(key, value, prior):
        n = Counter(verdict[f[0]] for f in spoken if f[key] == value)
        return [(n[x] + language.PRIOR * p) / (sum(n.values()) + language.PRIOR) for x, p in zip(model.langs, prior, strict=True)] if n else prior

    n = Counter(verdict.values())
    base = [(n[x] + 1) / (len(spoken) + len(model.langs)) for x in model.langs]
    got = {r["kept"]["doc_id"]: r for r in language.identify(df, address_col="url", host_col=None).collect()}
    assert len(got) == len(rows)
    for i, text, declared, host, domain, suffix in facts:
        if not language.letters(text):
            assert got[i]["rejected"] and got[i]["detected"] is None
            continue
        seen = any(f[3] == host for f in spoken) and host
        levels = share(5, suffix, base) if suffix else base
        levels = share(4, domain, levels) if domain else levels
        x = model(text) + np.log(share(3, host, levels) if seen else base)
        for key, value in ((2, declared), (5, suffix)):
            known = {f[key] for f in spoken if f[key]}
            if value in known:
                for k, lang in enumerate(model.langs):
                    mine = [f for f in spoken if f[key] and verdict[f[0]] == lang]
                    x[k] += np.log((sum(f[key] == value for f in mine) + 1) / (len(mine) + len(known) + 1))
        p = np.exp(x - x.max())
        p /= p.sum()
        assert got[i]["posterior"] == pytest.approx(p.max(), abs=1e-9)
        assert got[i]["detected"] == (model.langs[int(p.argmax())] if p.max() >= language.LEAST else None)


def test_language_agrees_with_declarations(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify(docs).select("declared", "text_lang").collect()
    assert sum(r[0] == r[1] for r in out) > 0.97 * len(out)


def brute_passage(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(cost[j - 1] + (w != v), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def test_leaks_match_brute_force(spark):
    items = [(k, prose(n)) for k, n in enumerate((15, 22, 40, 59, 6, 1, 3))] + [(20, None), (21, ""), (22, "..."), (2, prose(18))]
    items = [(k, t if n != 5 else "uniqueword") for n, (k, t) in enumerate(items)]
    docs = [(i, t) for i, t in ROWS]
    for d in range(100, 130):
        ws = (items[d % 7][1]).split()
        for _ in range(RNG.randrange(0, 3)):
            ws[RNG.randrange(len(ws))] = "typo"
        docs.append((d, f"{prose(20)} {' '.join(ws).upper()}, {prose(10)}" if d % 3 else " ".join(ws)))
    out = decontam.find_leaks(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, leaks string"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, edits int"))
    got = Counter((r["kept"]["doc_id"], x["item_id"], x["edits"]) for r in out.collect() for x in r["leaks"])
    expected = Counter()
    for i, t in docs:
        ws = decontam.normal_words(t)
        if len(ws) > 1000:
            continue
        for k, item in items:
            iw = decontam.normal_words(item)
            if iw and (e := brute_passage(iw, ws)) <= decontam.allowed(len(iw)):
                expected[i, k, e] += 1
    assert all(got[x] == n for x, n in expected.items() if x[2] == 0)
    assert not set(got) - set(expected) and sum((expected - got).values()) <= 1


def test_leaks_over_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    items = [(k, prose(20)) for k in range(7)]
    docs = spark.createDataFrame([(k, f"{prose(9)} {t} {prose(9)}") for k, t in items], "doc_id long, text string")
    out = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["kept"]["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in out.collect()} == {k: [k] for k in range(7)}


def test_empty_tables(spark, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    items = spark.createDataFrame([], "item_id long, text string")
    assert bpe.bpe(nothing, path, public_tokenizers.PATTERN).count() == 0
    assert sharding.shuffle_into_shards(nothing, 16).count() == 0
    assert jaccard.join_components(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0
    assert substrings.dedup_substrings(nothing).count() == 0
    assert ctw.score(nothing).count() == 0
    assert decontam.find_leaks(nothing, items).count() == 0
    assert language.identify(nothing).count() == 0


def test_bitmaps_never_forbid_an_overlap():
    rng = np.random.default_rng(7)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 180)), replace=False)) for _ in range(2))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        alone = sum(((p & ~q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))
        assert len(np.intersect1d(a, b)) <= len(a) - alone


@pytest.mark.parametrize("size", [20, 40, 59])
@pytest.mark.parametrize("how", ["cut", "deleted at the end", "deleted inside"])
def test_recall_of_passages_that_lack_words(size, how):
    rng, met = random.Random(f"{size} {how}"), 0
    for _ in range(100):
        item = [f"i{rng.randrange(5000)}" for _ in range(size)]
        k = decontam.allowed(size)
        gone = set(range(size - k, size)) if how == "cut" else set(rng.sample(range(size), k))
        text = [f"t{rng.randrange(5000)}" for _ in range(80)] + [x for i, x in enumerate(item) if i not in gone]
        text += [f"t{rng.randrange(5000)}" for _ in range(80)] if how == "deleted inside" else []
        met += bool(decontam.Items([(1, " ".join(item))]).find([" ".join(text)])[0])
    print(how, size, met)
    assert met >= 95


@pytest.mark.parametrize("kind", ["substituted", "inserted", "deleted", "mixed"])
@pytest.mark.parametrize("place", ["start", "middle", "end"])
def test_recall_at_the_most_edits(kind, place):
    rng, met, asked = random.Random(f"{kind} {place}"), 0, 0
    for size in (10, 20, 45, 60):
        for _ in range(60):
            item = [f"i{rng.randrange(5000)}" for _ in range(size)]
            passage = list(item)
            for _ in range(decontam.allowed(size)):
                at, now = rng.randrange(len(passage)), kind if kind != "mixed" else rng.choice(["substituted", "inserted", "deleted"])
                if now == "deleted":
                    del passage[at]
                else:
                    passage[at : at + (now == "substituted")] = [f"s{rng.randrange(5000)}"]
            other = lambda there: [f"t{rng.randrange(5000)}" for _ in range(80)] if there else []
            text = other(place != "start") + passage + other(place != "end")
            met += bool(decontam.Items([(1, " ".join(item))]).find([" ".join(text)])[0])
            asked += 1
    assert met >= 0.95 * asked


def test_languages_of_pages(spark, sf):
    import __spark_entry__

    got = {r["page_id"]: r for r in __spark_entry__.queries()["op3_pages"](spark, sf).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want = {k: re.search(r'<html lang="(\w+)"', x)[1] for k, x in pages.items()}
    assert {k: r["declared"] for k, r in got.items()} == want
    assert sum(got[k]["detected"] == want[k] for k in want) >= 0.9 * len(want)


def test_suffix_and_host_of_pages_speak(spark):
    page = "<html{}><body><article><p>{}</p></article></body></html>"
    rows = [(k, f"http://a{k % 5}.example.{'de' if k % 2 else 'fr'}/", page.format(f" class=x lang={'de-AT' if k % 2 else 'fr'}", ("der die das und nicht " if k % 2 else "le la les est pas ") * 9)) for k in range(60)]
    rows += [(100, "http://a1.example.de/", page.format("", "xq")), (101, "http://a1.example.fr/", page.format("", "xq")), (102, None, None)]
    got = {r["page_id"]: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).selectExpr("kept.page_id", "*").collect()}
    assert got[100]["detected"] == "de" and got[101]["detected"] == "fr" and got[102]["rejected"]
    assert got[1]["declared"] == "de" and got[100]["declared"] is None


def test_more_than_200_declared_languages(spark):
    names = [a + b for a in "abcdefghijklmnop" for b in "abcdefghijklmn"]
    rows = [(i, " ".join(f"{x}{x}q{x}" for _ in range(30)), x) for i, x in enumerate(names)] + [(1000 + i, f"{x}{x}q{x} " * 30, x) for i, x in enumerate(names[:200])]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), host_col=None).collect()
    assert len(names) > 200 and all(r["text_lang"] == r["declared"] for r in got)
