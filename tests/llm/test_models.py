"""Language, toxicity, top-k search, packing and web pages."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystead.llm import common, htmltext, langid, packing, topk, toxicity

from .helpers import frame, prose

INSULTS = ["vile", "rotten", "foul", "nasty", "odious", "wretched", "crass", "lousy", "beastly", "rude"]
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_langid(train, texts):
    """(language, score) of each text, in plain Python: 3-grams of letters, their hashes, counts and likelihoods."""
    m32 = (1 << 32) - 1

    def grams(text):
        runs, run = [], ""
        for c in text or "":
            low = c.lower()
            if c.isalpha():
                run += low if len(low) == 1 else c
            elif run:
                runs.append(run)
                run = ""
        s = "  " + "".join(r + " " for r in runs) + run
        out = []
        for k in range(2, len(s)):
            h = (ord(s[k]) * 0x9E3779B1 + ord(s[k - 1]) * 0x85EBCA77) & m32
            h ^= h >> 15
            h = (h * 0x2C1B3C6D + ord(s[k - 2]) * 0xC2B2AE3D) & m32
            h ^= h >> 16
            h = h * 0x7FEB352D & m32
            out.append((h ^ h >> 15) % 65536)
        return out

    counts, seen = {}, {}
    for t, g in train:
        if g is not None and t is not None and any(c.isalpha() for c in t):
            seen[g] = seen.get(g, 0) + 1
            own = counts.setdefault(g, {})
            for f in grams(t):
                own[f] = own.get(f, 0) + 1
    out = []
    for t in texts:
        found = grams(t)
        if not any(c.isalpha() for c in t or "") or not counts:
            out.append(("und", 0.0))
            continue
        logs = {}
        for g in sorted(counts):
            total = sum(counts[g].values()) + 0.5 * 65536
            prior = math.log(seen[g] / sum(seen.values()))
            logs[g] = (prior + sum(math.log((counts[g].get(f, 0) + 0.5) / total) for f in found)) / math.sqrt(len(found))
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_languages_in_several_matrices(spark, monkeypatch):
    """Many languages, scored few at a time, with ties between languages that were taught the same."""
    rng = random.Random(14)
    rows = [(i, prose(rng, 8, [f"{chr(97 + i % 9)}{x}" for x in ("ra", "te", "mo", "ze", "ki", "élu")]), f"l{i % 9:02}" if i % 18 else "twin", None) for i in range(200)]
    rows += [(500, "abra", "z1", None), (501, "abra", "z2", None), (502, "abra", None, None), (502, "abra", None, None), (503, "x" * 300_000, None, None), (504, None, "l01", None), (505, "12", "l02", None)]
    want = brute_langid([(t, g) for i, t, g, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2], [t for _, t, _, _ in rows])
    results = []
    for many in (128, 4, 1):
        monkeypatch.setattr(langid, "LANGUAGES", many)
        results.append(sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.identify(frame(spark, rows)).collect()))
    assert results[0] == results[1] == results[2]
    for (i, lang, s), (w, ws) in zip(results[0], [x for _, x in sorted(zip([r[0] for r in rows], want))]):
        assert lang == w and s == pytest.approx(ws, abs=2e-4), i


def test_language_scores_against_brute_force(spark):
    rng = random.Random(1)
    one, two = ["abra", "cada", "Bra", "émile"], ["zoo", "wyx", "quux", "ñandú"]
    rows = [(i, prose(rng, 12, one if i % 2 else two), "aa" if i % 2 else "bb", None) for i in range(60)]
    rows += [(100, None, "aa", None), (101, "", "bb", None), (102, "123 !?", "aa", None), (None, "abra cada", "aa", None), (103, "zoo", None, None)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False)
        if i is None or i < 100 or i == 103:
            assert r["lang_pred"] == (lang or "bb") and 0 < r["score"] <= 1
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)

    held_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    want = brute_langid([(t, g) for i, t, g, _ in rows if not held_out(i)], [t for _, t, _, _ in rows])
    by_text = {}
    for (_, t, _, _), w in zip(rows, want):
        by_text[t] = w
    for i, t, _, _ in rows:
        assert got[i]["lang_pred"] == by_text[t][0] and got[i]["score"] == pytest.approx(by_text[t][1], abs=1e-4)
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_features_do_not_cross_rows():
    parts = ["Ab c", "", "ÉÉ1é", "x", "!!", "ab\U0001d400c"]
    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(p.encode()) for p in parts]])
    feats, bounds, has = langid.features(raw, offs)
    assert has.tolist() == [True, False, True, True, False, True]
    for i, p in enumerate(parts):
        own = np.frombuffer(p.encode(), np.uint8)
        assert feats[bounds[i] : bounds[i + 1]].tolist() == langid.features(own, np.array([0, len(own)]))[0].tolist()


def test_toxic_documents_are_found(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        text = prose(rng, 80).split()
        toxic = i % 5 == 0
        if toxic:
            for word in rng.sample(INSULTS, rng.choice([2, 3, 6, 9])):
                text.insert(rng.randrange(len(text)), rng.choice([word, word.upper(), word + ",", word + "."]))
        rows.append((i, " ".join(text), "en", "s"))
        if i < 800:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None), (5001, "", None, None), (None, "plain words", None, None)]
    labels += [(None, 1, 1), (3, 1, None), (9999, 0, 1)]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == toxicity.LEVELS
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    held = [i for i in range(800, 1200)]
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in held)
    assert not got[5000]["toxic"] and not got[None]["toxic"] and len(got) == len(rows)
    severe = {n: np.mean([got[i]["severity"] for i in range(0, 1200, 5) if sum(w.lower().strip(",.") in INSULTS for w in rows[i][1].split()) == n]) for n in (2, 9)}
    assert severe[9] > severe[2] > 0.5
    assert all((r["grade"] > 0) == r["toxic"] for r in got.values())
    clash = docs.selectExpr("*", "1 as toxicity", "2 as _toxicity_toxic", "3 as grade", "4 as `a.b`")
    kept = toxicity.keep(clash, lab)
    assert kept.columns == clash.columns and kept.count() == len(rows) - 240 and kept.where("toxicity = 1 and grade = 3").count() == len(rows) - 240
    long = frame(spark, [(1, "plain " * 300_000 + "vile rotten foul nasty", None, None), (1, "plain", None, None), (1, "plain", None, None)])
    assert sorted(r["toxic"] for r in toxicity.grade(long, model).collect()) == [False, False, True]
    assert toxicity.grade(docs, toxicity.train(docs, lab.limit(0))).where("toxic").count() == 0
    assert toxicity.grade(docs, toxicity.train(docs, lab.where("toxic = 1"))).where("toxic").count() == 0
    assert toxicity.grade(frame(spark, []), model).count() == 0


def test_toxic_labels_beyond_the_first_thousands_count(spark):
    """The only toxic documents are those behind 9,000 others in the order of the sample."""
    order = [r["id"] for r in spark.range(10_000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[9_000:])
    rng = random.Random(6)
    rows = [(i, prose(rng, 6) + (" vile" if i in late else ""), "en", "s") for i in range(10_000)]
    docs, lab = frame(spark, rows), spark.createDataFrame([(i, 1, int(i in late)) for i in range(10_000)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"] for r in toxicity.grade(docs, toxicity.train(docs, lab)).where("toxic").collect()}
    assert found == late


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    """The documents that are there come last in the order of the sample, and it is as large as they are many."""
    order = [r["id"] for r in spark.range(1000).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + (" vile" if i % 4 == 0 else ""), "en", "s") for i in order[800:]]
    docs, lab = frame(spark, rows + rows[:3]), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in order], "doc_id long, quality int, toxic int")
    found = {r["doc_id"] for r in toxicity.grade(docs, toxicity.train(docs, lab, most=200)).where("toxic").collect()}
    assert found == {i for i in order[800:] if i % 4 == 0}


def test_gradient_of_the_ordinal_model():
    """The fitted thresholds reproduce the shares of grades that carry no features."""
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 3000)
    places = [np.array([0, 1 + i % 7]) for i in range(3000)]
    model = toxicity.fit(places, grades, np.arange(8, dtype=np.uint64))
    p = model.probabilities(np.zeros(1))[0]
    assert p == pytest.approx(np.bincount(grades) / 3000, abs=0.03) and p.sum() == pytest.approx(1)


def test_fit_against_a_dense_one():
    """The sparse solver against plain gradient descent on the dense likelihood, written out on its own."""
    rng = np.random.default_rng(4)
    n, d, k = 400, 6, 3
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = np.clip((x @ np.array([2.0, 1.0, -1.0, 0, 0, 0.5]) + rng.logistic(size=n)).round(), 0, k).astype(int)

    def loss(params):
        w, t = params[:d], np.concatenate([[-40], params[d:], [40]])
        total = 0.0
        for row, g in zip(x, y):
            s = row @ w
            total -= math.log(1 / (1 + math.exp(s - t[g + 1])) - 1 / (1 + math.exp(s - t[g])))
        return total / n + toxicity.PENALTY * np.abs(w).sum()

    places = [np.flatnonzero(row) for row in x]
    i, j = np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate(places)
    w, theta = toxicity._solve(i, j, n, d, y, k)
    best = np.concatenate([w, theta])
    params, size = np.concatenate([np.zeros(d), [-1.0, 0.0, 1.0]]), 1.0
    here = loss(params)
    for _ in range(150):  # gradient descent by finite differences, halving the step where it doesn't help
        slope = np.array([(loss(params + e) - loss(params - e)) / 2e-5 for e in 1e-5 * np.eye(d + k)])
        while (there := loss(params - size * slope)) >= here and size > 1e-7:
            size /= 2
        params, here, size = params - size * slope, min(here, there), size * 1.5
    assert loss(best) <= here + 1e-4 and np.allclose(best, params, atol=0.12)
    # the expected severity is the mean of the grades
    model = toxicity.Model(np.arange(d, dtype=np.uint64), w, theta)
    p = model.probabilities(x @ w)
    assert np.allclose(p.sum(axis=1), 1) and abs((p @ np.arange(k + 1)).mean() - y.mean()) < 0.02


def brute_topk(rows, k):
    out = []
    fine = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in fine if i % 50 == 0}):
        own = next(v for i, v in fine if i == q)
        found = sorted((-int(own @ v), i) for i, v in fine if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in (centres[i % 8] + 0.2 * rng.normal(size=16)).astype(np.float32)]) for i in range(700)]
    rows[100] = (100, rows[0][1])
    rows += [(700 + i, rows[7][1]) for i in range(60)]  # one vector many times
    rows += [(None, rows[1][1]), (900, None), (901, [float("nan")] * 16), (902, [None] + [1.0] * 15), (950, [1.0, 2.0]), (951, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").where(topk.usable(F.col("embedding")))
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = [tuple(r) for r in topk.search(vectors, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == brute_topk(rows, 5)
    few = [tuple(r) for r in topk.search(vectors.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(few) == brute_topk(rows[:3], 5)
    assert topk.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_eliminate():
    """Results are exact for each kind of number, and most pairs of vectors with few strong directions aren't evaluated."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(2000, 64)) * 200 * 0.8 ** np.arange(64)).astype(np.int64)
    ids = np.arange(len(x))
    for scale in (1, 10**3, 10**6):
        y = x * scale
        at = topk.Pivots(y[100:124].tolist()).place(y)[0]
        got, evaluated = topk.best_of(y[:20], y, at[:20], at, ids[:20], ids, 3, np.full(20, -np.inf))
        assert evaluated < 0.25 * 20 * len(y)
        s = y[:20].astype(object) @ y.T.astype(object)
        for i, (_, c, score) in enumerate(got):
            order = sorted((j for j in range(len(y)) if j != i), key=lambda j: (-s[i, j], j))[:3]
            assert c.tolist() == order and score.tolist() == [s[i, j] for j in order]
    # points of the table bound every product
    at = topk.Pivots(x[:30].tolist()).place(x)[0]
    assert (at[:50] @ at.T + 1e-3 >= x[:50].astype(float) @ x.T.astype(float)).all()


def test_cells_that_can_not_hold_a_result_are_not_visited(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16)) * 4000
    x = [(int(i), [int(v) for v in centres[i % 6] + 20 * rng.normal(size=16)]) for i in range(900)]
    asked, meet = [], topk._meet
    monkeypatch.setattr(topk, "_meet", lambda left, right, k: asked.append(left.count()) or meet(left, right, k))
    got = [tuple(r) for r in topk.search(spark.createDataFrame(x, "vec_id long, v array<bigint>"), F.col("vec_id") % 50 == 0, pivots=24).collect()]
    m = np.array([v for _, v in x])
    want = []
    for q in range(0, 900, 50):
        order = sorted((j for j in range(900) if j != q), key=lambda j: (-int(m[q] @ m[j]), j))[:5]
        want += [(q, r + 1, j, int(m[q] @ m[j])) for r, j in enumerate(order)]
    assert sorted(got) == want and asked[0] == 18 and asked[1] < 0.5 * 18 * 23


def test_scores_that_do_not_fit_raise(spark):
    big = spark.createDataFrame([(0, [2**62, 0]), (1, [3, 1]), (2, [-(2**62), 5])], "vec_id long, v array<bigint>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(big, F.col("vec_id") == 0, k=1).collect()
    fine = spark.createDataFrame([(0, [2**61, 0]), (1, [3, 1]), (2, [-(2**62), 5])], "vec_id long, v array<bigint>")
    assert [tuple(r) for r in topk.search(fine, F.col("vec_id") == 0, k=1).collect()] == [(0, 1, 1, 3 * 2**61)]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1e30, 1.0],)], "v array<double>").select(topk.quantised(F.col("v"))).collect()


def encode(texts):
    column = pa.array(texts, pa.large_string())
    coder = packing.ChunkEncoder(JSON, RANKS)
    out = []
    for _, n, raw, offs in common.text_parts(column, 1 << 20):
        ids, bounds = coder.encode(raw, offs)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\t\r\x0b\x1c  　\u0085aZé9'st<|endoftext|>.,ßñ中"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = test_chunks_encode_as_whole_texts.__dict__.setdefault("t", Tokenizer.from_file(JSON))
    assert encode(texts) == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_pieces_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, n), None, None) for i, n in enumerate([0, 1, 5, 300, 3000, 9000])] + [(50, None, None, None), (None, "<|endoftext|> x", None, None), (51, "same", None, None), (51, "same", None, None)]
    got = packing.pack(frame(spark, rows), JSON, RANKS, 1024).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    docs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"])):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] == 2 ** r["bucket"] <= 1024 and r["offset"] == 0
        docs.setdefault((r["doc_id"], r["sequence_id"] - r["start"] * 0 if r["doc_id"] == 51 else 0), {})[r["start"]] = ids
    want = dict(zip([r[0] for r in rows], encode([r[1] or "" for r in rows])))
    for (i, _), parts in docs.items():
        if i != 51:
            assert sum((parts[s] for s in sorted(parts)), []) == want[i]
    assert sum(r["length"] for r in got if r["doc_id"] == 51) == 2 * len(want[51])
    assert packing.pack(frame(spark, []), JSON).count() == 0
    assert packing.split(2048 * 2 + 7) == [2048, 2048, 4, 2, 1] and packing.split(0) == []


def test_buckets_are_written_apart(spark, tmp_path):
    rng = random.Random(4)
    docs = frame(spark, [(i, prose(rng, n), None, None) for i, n in enumerate([3, 70, 400, 400])])
    pieces = packing.pack(docs, JSON, RANKS, 64)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    key = lambda r: (r["doc_id"], r["start"], bytes(r["ids"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, pieces.collect()))
    for folder in (tmp_path / "b").glob("bucket=*"):
        n = 2 ** int(folder.name.split("=")[1])
        assert {r["length"] for r in spark.read.parquet(str(folder)).collect()} == {n} and n <= 64


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>hidden</p> --><div class="ad-slot">Buy</div>
<article><header><h1>The&nbsp;Title</h1></header><p>One <b>two</b>&amp;three &lt;x&gt; &#233;&#x20AC;<br>four</p><aside>Side</aside><form>Name <input></form>
<div class="cookie-notice">Cookies</div><p>a
  b</p><footer>By</footer><section class="comments"><p>First!</p></section></article><div id="comments">Reader</div><footer>Foot</footer></body></html>"""


def test_article_of_a_page():
    assert "\n".join(htmltext.blocks(PAGE)[0]) == "The Title\nOne two&three <x> é€ four\na b"
    cut = PAGE[: PAGE.index("a\n  b")] + "end of pa"
    assert "\n".join(htmltext.blocks(cut)[0]) == "The Title\nOne two&three <x> é€ four\nend of pa"
    assert htmltext.blocks("") == ([], [], False)
    assert htmltext.blocks("<p>x<div class=ad>lost<article>found &am")[0] == ["found &am"]
    assert htmltext.blocks("plain < text")[1] == ["plain < text"]
    assert htmltext.blocks("<p>a</p><footer unclosed")[1] == ["a"]


def test_article_text_that_looks_like_boilerplate_stays():
    inside = lambda x: htmltext.blocks(f"<body><nav>m</nav><article>{x}</article><p>out</body>")[0]
    assert inside('<section id="notice"><p>one</p><p>two</p></section>') == ["one", "two"]
    assert inside('<h3 id="search">Search trees</h3><p id="sharing">x</p>') == ["Search trees", "x"]
    assert inside('<p class="widget-demo">one</p><p class="has-ad">two</p>') == ["one", "two"]
    assert inside("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> holds</p>") == ["so x=1 holds"]
    assert inside("<p>a <audio src=x>no player</audio> b</p>") == ["a no player b"]
    assert inside("<nav><ul><li>menu</ul><p>one</p><p>two</p>") == ["one", "two"]
    assert htmltext.blocks("<body><div><nav><a>menu</a></div><div>one</div><p>two</p></body>")[1] == ["one", "two"]
    assert htmltext.blocks("<main><p>intro</p><article>teaser</article><p>body</p></main>")[0] == ["intro", "teaser", "body"]
    assert htmltext.blocks("<main><p>by</p><article>the story</article><p>x</p></main>")[0] == ["the story"]
    # marks still go
    for mark in ('div class="cookie-notice"', 'div class="ad-slot-3"', 'div class="share buttons"', 'div id="comments"', 'section id="comments"', 'section class="comments"', 'div id="notice"', 'p class=ad', 'ul class="related-posts"', "div class='newsletter_signup-box'", 'div class="article-ad"', 'div class="wp-block-comments"', 'ins class=adsbygoogle', "div role=alert", "div hidden"):
        assert inside(f"<p>one</p><{mark}><i>gone</i></{mark.split()[0]}><p>two</p>") == ["one", "two"], mark
    assert htmltext.blocks('<body class="has-sidebar"><div class="main-content"><p>one</p></div></body>')[1] == ["one"]


def test_generated_pages(spark):
    """Pages whose article text is known, in many layouts, compared exactly."""
    rng = random.Random(21)
    junk = ["<nav><ul><li><a href=/x>Home</a><li>News</ul></nav>", "<div class=ad>Buy now</div>", "<aside><p>Side</p></aside>", "<form><label>Name <input></label><button>Go</button></form>", "<!-- <p>no</p> -->",
            '<div class="cookie-notice"><p>Cookies</p></div>', "<script>var a='</p><p>no'</script>", "<style>p{}</style>", '<section class="comments"><h2>Comments</h2><p>First!</p></section>', '<div class="share-buttons">Share</div>']
    rows, want = [], {}
    for i in range(300):
        parts, lines = [], []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.4:
                parts.append(rng.choice(junk))
            words = [rng.choice(["red", "a&b", "x<y", "é", "10 €", "it's", "von", "c"]) for _ in range(rng.randrange(1, 12))]
            marked = [f"<{t}>{w}</{t}>" if (t := rng.choice(["b", "i", "em", "", "", ""])) else w for w in (w.replace("&", "&amp;").replace("<", "&lt;").replace("€", rng.choice(["€", "&euro;", "&#8364;", "&#x20AC;"])) for w in words)]
            tag = rng.choice(['p', 'p', 'h2 id="search"', 'blockquote', 'p class="widget-demo"', 'div', 'section id="notice"'])
            parts.append(f"<{tag}>{rng.choice([' ', chr(10) + '  ']).join(marked)}" + ("" if tag == "p" and rng.random() < 0.5 else f"</{tag.split()[0]}>"))
            if tag == "p" and parts[-1].endswith("</p>") is False and rng.random() < 0.5:
                parts[-1] += "</p>"
            lines.append(" ".join(words))
        body = "".join(parts)
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id=page><article><header>{}</header></article></div>" if len(lines) == 1 else "<article>{}</article>"])
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body><header><h1>Site</h1></header>{rng.choice(junk)}{wrap.format(body)}{rng.choice(junk)}<footer>Foot</footer></body></html>"
        rows.append((i, f"http://h{i % 5}/p/{i}", page))
        want[i] = "\n".join(lines)
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    rows += [(1000, None, long), (1001, "http://h1/p/1", long), (0, rows[0][1], rows[0][2])]
    want |= {1000: "\n".join(["word"] * 60_000), 1001: "\n".join(["word"] * 60_000)}
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]], rows[r["page_id"]][2] if r["page_id"] < 300 else "long"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    same = htmltext.common_lines(a, b)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert len(same) == table[-1][-1]
    it = iter(b)
    assert all(a[i] in it for i in sorted(same))


def test_marked_elements_without_an_end_tag():
    inside = lambda x: htmltext.blocks(f"<body><article>{x}</article><p>out</body>")[0]
    assert inside("<p>one<p class=notice>gone <b>too<p>two</b><p>three") == ["one", "two", "three"]
    assert inside("<p class=notice>gone<h2>two</h2>three") == ["two", "three"]
    assert inside("<ul><li>one<li class=share>gone<ul><li>also<li>this</ul>and<li>two</ul>three") == ["one", "two", "three"]
    assert inside("<ul><li class=share>gone</ul>three") == ["three"]
    assert inside("<dl><dt>a<dd class=ad>gone<dl><dt>x<dd>y</dl><dt>b<dd>c</dl>d") == ["a", "b", "c", "d"]
    assert inside("<table><tr class=ad><td>gone<td>too<tr><td>one<td class=ad>gone<td>two</table>three") == ["one two", "three"]
    assert inside("<div>one<p class=ad>gone <i>more</div>two") == ["one", "two"]
    # other unclosed elements go up to the next article or their parent's end
    assert htmltext.blocks("<div class=ad>gone<p>gone<article><p>one</article>")[0] == ["one"]
    assert inside("<div class=ad>gone<p>gone") == []


def test_pages_lose_what_their_neighbour_shares(spark):
    page = lambda *own: "<body>" + "".join(f"<div>{x}</div>" for x in ("Home | News", *own, "All rights")) + "</body>"
    rows = [
        (1, "http://h/a/1", page("one", "uno")), (2, "http://h/a/2", page("two")), (3, "http://h/b/9", page("nine")), (4, "http://other/a/1", page("alone")),
        (5, "http://h/c/1?x", page("same", "copy")), (6, "http://h/c/1?y", page("same", "copy")), (7, "http://h/z", PAGE), (8, None, page("no url")), (9, "http://h/e", None), (None, "http://h/q/1", ""),
    ]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got[1] == "one\nuno" and got[2] == "two" and got[3] == "nine"
    assert got[4] == "Home | News\nalone\nAll rights" and got[8] == "Home | News\nno url\nAll rights"
    assert got[5] == got[6] == "same\ncopy"  # copies are one page, whose neighbour is another one
    assert got[7].startswith("The Title") and got[9] == "" and got[None] == ""
    again = {r["page_id"]: r["text"] for r in htmltext.extract(df.repartition(5)).collect()}
    assert again == got and htmltext.extract(df.limit(0)).count() == 0


def test_differencing_runs_on_marked_pages_and_the_mark_checks_it(spark):
    page = lambda *own: f"<body><div>Site</div><article>{''.join(f'<p>{x}</p>' for x in own)}</article><div>Legal</div></body>"
    rows = [(1, "http://h/a/1", page("one", "two", "three")), (2, "http://h/a/2", page("one", "two", "four")), (3, "http://h/b", page("five")), (4, "http://k/a", page("one")), (5, None, page("one")), (6, "http://h/a/2", page("one", "two", "four"))]
    got = {r["page_id"]: tuple(r)[2:] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    copy = ("one\ntwo\nfour", 4, 2)  # Site, one, two and Legal are shared; the mark restores two of them
    assert got == {1: ("one\ntwo\nthree", 4, 2), 2: copy, 6: copy, 3: ("five", 2, 0), 4: ("one", 0, 0), 5: ("one", 0, 0)}


def test_the_verdict_of_differencing_decides_without_a_mark():
    assert htmltext.settle("<div>a</div><div>b</div><div>c</div>", [0, 2]) == ("b", 0)
    assert htmltext.settle("<div>a</div><main>b<p>c</main>", [0, 2]) == ("b\nc", 1)
    assert htmltext.settle("", []) == ("", 0)
    assert htmltext.unshared(["a", "b"], ["a", "b", "c"]) == [] and htmltext.unshared(["a", "x"], ["a", "b"]) == [0]
