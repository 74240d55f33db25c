"""Operators 3, 7, 8, 9 and 10 against brute force, on fixtures with nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import chunks, components, decontaminate, jaccard, language, main_text, quality
from cloakwork.llm.common import words
from cloakwork.llm.queries import ORACLE_SQL, fold, op3_decontaminate, op8_quality, op9_language

rnd = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(30)]


def text(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    grams = {}
    for i, t in items:
        if i is not None and (w := words(t)):
            n = min(window, len(w))
            for j in range(len(w) - n + 1):
                grams.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    found |= grams[g]
                    hit[j : j + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("shortest", [1, 2, 12])
def test_decontamination_by_definition(spark, shortest):
    base = [text(60) for _ in range(20)]
    items = [(k, " ".join(base[k].split()[5 : 5 + rnd.randint(shortest, 30)])) for k in range(12)] + [(90, None), (91, "..."), (None, base[1]), (92, base[0]), (93, base[0])]
    docs = [(k, t) for k, t in enumerate(base)] + [(100, None), (101, ""), (102, "W1, W2; w3"), (3, base[3]), (103, base[4].upper().replace(" ", " -- ")), (104, base[2][:80] + "é " + base[2])]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (4_000_000, 20):  # in one block, and in several
        found = decontaminate.contamination(d, b, block_words=blocks)
        rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, decontaminate.items_digest(r["items"]), r.contaminated) for r in found.collect()]
        assert sorted(map(repr, rows)) == brute_hits(docs, items)
    kept = decontaminate.remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.filter("not contaminated").collect())
    assert decontaminate.contamination(d.limit(0), b).count() == 0 and decontaminate.contamination(d, b.limit(0)).filter("contaminated").count() == 0


def test_longest_matches(spark):
    long = text(40)
    d = spark.createDataFrame([(1, "a b " + long + " c"), (2, " ".join(long.split()[:15]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, "zz " + long)], "item_id long, text string")
    got = {r.item_word: (r.length, r.doc_id, r.word) for r in decontaminate.longest_matches(d, b).collect()}
    assert got[1] == (40, 1, 2) and got[5] == (36, 1, 6) and 40 not in got


def test_suffix_array_by_definition():
    for _ in range(50):
        t = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 60))], np.int32)
        got = decontaminate.suffix_array(t, len(t))
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_op3_query_and_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = op3_decontaminate(spark, sf)
    want = con.sql(ORACLE_SQL["op3_decontaminate"]).df()[got.columns]
    assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, want.astype(object).values.tolist()))


# 7 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>x <b>y</b>\n z<p>q<br>r</article><footer>f</footer>", "A & B\nx y z\nq r"),
        ("<article><p>one</p><aside>no</aside><p>two</p><section class='comments'><p>said</p></section></article>", "one\ntwo"),
        ("<article><p><a href=x>all link</a></p><p>rest</p></article>", "all link\nrest"),
        ("<article><p>a<script>var s='</p>'</script>b</p><!-- c --><style>p{}</style><form>f</form></article>", "ab"),
        ("<div class='ad'>buy</div><article><p>cut &am", "cut &am"),
        ("<body><div class=cookie-notice>We use cookies</div><p>" + "Long text of the page. " * 8 + "</p><div id='sidebar'>" + "side " * 40 + "</div><p>" + "More of it. " * 9 + "</p></body>", ("Long text of the page. " * 8).strip() + "\n" + ("More of it. " * 9).strip()),
        ("<main><h2>T</h2><ul><li>1</li><li>2</li></ul></main>", "T\n1\n2"),
        ("<p>tiny</p>", "tiny"),
        ("a < b and <p", "a < b and"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer></article><section class='comments'><article><p>I said</p></article></section>", "T\nx"),
        ("<div class='with-sidebar'><p>all of it</p></div>", "all of it"),
        ("<main><div id=menu>m</div><article>a</article><p>teaser</p></main>", "a"),
        ("<div class=nav><article>left open before</article>", "left open before"),
        ("<article>a</article><article class='comment'>no</article>", "a"),
    ],
)
def test_main_text(html, want):
    assert main_text.main_text(html) == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é</article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text.extract(pages).collect()}
    assert got == {1: ("u", "é", 1), 2: (None, "", 0)}
    assert main_text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        import html

        lines = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text.main_text(r.html) == "\n".join(x for x in lines if x)


# 8, 9 ---------------------------------------------------------------------------------------------------------------


def test_features_by_definition():
    t = "Hello, World!! 12 é\nHello, World!!\n** x x"
    f = dict(zip(quality.FEATURES, quality.features(pa.array([None, "", t, t]))[3], strict=True))
    raw, w = t.encode(), t.split()
    assert f["log_bytes"] == pytest.approx(np.log1p(len(raw))) and f["log_words"] == pytest.approx(np.log1p(len(w)))
    assert f["upper_share"] == pytest.approx(sum(map(str.isupper, t)) / sum(c.isascii() and c.isalpha() for c in t))
    assert f["distinct_word_share"] == pytest.approx(len(set(w)) / len(w)) and f["distinct_line_share"] == pytest.approx(1.0)
    assert f["adjacent_word_repeat"] == pytest.approx(1 / len(w)) and f["repeated_sign_share"] == pytest.approx(3 / len(raw))
    assert (quality.features(pa.array([None, ""], pa.string())) == quality.features(pa.array(["", ""]))).all()


def test_additive_model_learns_pairs():
    g = np.random.default_rng(1)
    x = g.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # neither feature alone says anything
    m = quality.train(x, y, rounds=60)
    p = m.score(x)
    assert ((p > 0.5) == y).mean() > 0.95 and (m.pairs[0][0], m.pairs[0][1]) == (0, 1)
    b = m.bins(x[:50])
    by_hand = [m.base + sum(t[b[r, j]] for j, t in enumerate(m.single)) + sum(t[b[r, i], b[r, j]] for i, j, t in m.pairs) for r in range(50)]
    assert m.score(x[:50]) == pytest.approx(1 / (1 + np.exp(-np.array(by_hand))))
    assert quality.train(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_op8_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_op9_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in op9_language(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].lang_pred == x for i, x in truth.items() if got[i].held_out]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog sat there" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", i) for i in range(40)] + [(50, None, "en", 0), (51, "12 !! –", "de", 0), (52, "Привет мир", None, 0), (53, "", "en", 0)], "doc_id long, text string, lang string, score int")
    m = language.fit(docs, F.col("k") >= 0)
    got = {r.doc_id: r for r in language.identify(docs, m).collect()}
    assert [got[i].lang_pred for i in (0, 1, 50, 51, 53)] == ["de", "en", "und", "und", "und"] and got[50].score == 0 and got[52].lang_pred in ("de", "en")
    kept = language.accepted(docs, m)
    assert kept.columns == docs.columns and {0, 1} <= {r.doc_id for r in kept.collect()} and not {50, 51, 53} & {r.doc_id for r in kept.collect()}
    none = language.fit(docs.limit(0), F.col("k") >= 0)
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


# 10 -----------------------------------------------------------------------------------------------------------------


def brute_classes(docs, threshold=0.8, n=5):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(docs)
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(docs))


def mutated(t, n):
    w = t.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"m{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_by_definition(spark, block):
    """With blocks of four, every group is dealt into many pairs of blocks."""
    base = [text(120) for _ in range(6)]
    docs = []
    for b in base:
        docs += [b] * 3 + [mutated(b, k) for k in (1, 1, 2, 2, 3, 4, 6, 9, 14)]
    docs += ["w1", "w1", "w1 w2 w3", "W1, w2. W3", "w1 w2 w3 w4", "", "!!"]
    docs = list(enumerate(docs, 10))
    d = spark.createDataFrame([(*r, 5) for r in docs] + [(900, None, 6)], "doc_id long, text string, class_id int")
    got = sorted(tuple(r) for r in jaccard.similar_documents(d, block=block).collect())
    assert got == sorted([*brute_classes(docs), (900, 900, 0)])
    kept = jaccard.one_of_each(d, block=block)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in got if i == c)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(empty).count() == 0
    same = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar_documents(same).collect()) == [(2, 2, 2), (4, 2, 2), (4, 2, 2)]


def test_pruning_keeps_what_reaches_the_threshold():
    """The table's bound holds against the exact tail of the posterior."""
    from math import comb

    t = 0.8 + 0.2 / 256
    for k, need in enumerate(jaccard.least_matches(0.8, 1e-6), 1):
        n = k * jaccard.CHUNK
        tail = lambda m, n=n: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        assert tail(need) >= 1e-6 > tail(need - 1)
    assert (1 - 0.8 ** jaccard.rows_per_band(0.8)) ** (jaccard.HASHES // jaccard.rows_per_band(0.8)) <= jaccard.MISS


def test_components(spark):
    edges, n = [], 200
    for _ in range(150):
        edges.append((rnd.randrange(n), rnd.randrange(n)))
    edges += [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]  # a long chain, a loop, a null
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_folds(spark):
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# words that share a hash --------------------------------------------------------------------------------------------


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


#: Two words that a polynomial hash modulo 2**64 can't tell apart, whatever its base.
ALIKE = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048)]


@pytest.fixture(params=["hashes", "one hash for all"])
def hashing(request, monkeypatch):
    """Results must not depend on hashes: they are the same if all chunks of more than SHORT bytes collide."""
    if request.param != "hashes":
        monkeypatch.setattr(chunks, "long_hashes", lambda data, starts, ends, words: np.full(len(starts), 7 << 9, np.uint64))
    return request.param


def test_decontamination_of_colliding_words(hashing):
    for a, b in ALIKE:
        item = f"one two three {a} four five six seven eight nine ten"
        texts = [item, item.replace(a, b), f"x {item} {b}", "antidisestablishment " + item[:60]]
        tests = decontaminate.TestItems([(1, item), (2, f"{b} antidisestablishmenu")])
        (_, _, data, offsets), = chunks.blocks(pa.array(texts))
        shard = decontaminate.Shard(data, offsets)
        docs, found = shard.mark(tests)
        assert sorted(zip(docs.tolist(), found.tolist(), strict=True)) == [(0, 0), (2, 0)]
        assert shard.hit.tolist() == [True] * 11 + [False] * 11 + [False] + [True] * 11 + [False] + [False] * int(shard.n_words[3])


def test_features_of_colliding_words(hashing):
    (a, b), (c, d) = ALIKE
    texts = [f"{a} {b} {a} {a}\n{c}\n{d}\n{c}", f"{a} {a}\n{b} {b}", "x"]
    f = quality.features(pa.array(texts))
    names = quality.FEATURES
    for row, t in zip(f, texts, strict=True):
        w, lines = t.split(), t.split("\n")
        assert row[names.index("distinct_word_share")] == pytest.approx(len(set(w)) / len(w)) and row[names.index("distinct_line_share")] == pytest.approx(len(set(lines)) / len(lines))
        assert row[names.index("adjacent_word_repeat")] == pytest.approx(sum(x == y for x, y in itertools.pairwise(w)) / len(w))


def test_losses_of_colliding_words(hashing):
    m = language.KneserNey.fit({"a": {b"ababbaab": 5, b"aab": 2}, "b": {b"baababba": 5, b"bba": 3}})
    texts = [x for pair in ALIKE for x in pair] + ["ababbaabab baababbaba ababbaabab"]
    got = language.Scorer(m, 3.0).score(pa.array(texts))[2]
    for t, e in zip(texts, got, strict=True):
        each = m.losses([w.encode() for w in t.split()]).sum(0)
        assert e == pytest.approx(min(each[1:] / each[0]), rel=1e-5)


def test_exact_sets_by_definition(hashing):
    (a, b), _ = ALIKE
    texts = [f"{a} x y z w v", f"{b} x y z w v", f"x y z w v {a} {b}", "x y", "x y z w v", f"{a} {b} " * 5, "antidisestablishment x y z w", "antidisestablishmenu x y z w"]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    got = [set(x.tolist()) for x in jaccard.exact_sets([t.strip().encode() for t in texts], 5)]
    for i, j in itertools.product(range(len(texts)), repeat=2):
        assert len(got[i] & got[j]) == (len(want[i] & want[j]) if i == j or min(len(texts[k].split()) for k in (i, j)) >= 5 else 0), (i, j)


def test_colliding_words_in_queries(spark):
    """The same through Spark, in all operators of whole texts."""
    (a, b), (c, d) = ALIKE
    tail = " ".join(VOCABULARY[:12])
    docs = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{c} {b} u v w x y z"), (4, f"{d} {b} u v w x y z"), (5, f"{c} {b} u v w x y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar_documents(df).collect()) == brute_classes(docs)
    items = spark.createDataFrame([(1, f"{a} {c}"), (2, f"{d} {b} u v")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contamination(df, items).filter("contaminated").collect()) == [4]


# long texts and repeated rows ---------------------------------------------------------------------------------------


def test_long_texts_and_repeated_rows(spark):
    """A text of 200,000 words, equal rows and null ids, through operators 3, 8, 9 and 10."""
    long = " ".join(f"word{i % 5000}x{i % 7}" for i in range(200_000))
    rows = [(1, long, "en"), (1, long, "en"), (2, long + " end", "en"), (None, "a short text of some seven words", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    items = spark.createDataFrame([(7, " ".join(long.split()[150_000:150_030]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(df, items).collect()}
    assert found[1].contaminated and found[1].n_words == 200_000 and found[2].n_hit == found[1].n_hit and not found[None].contaminated
    got = sorted(map(repr, map(tuple, jaccard.similar_documents(df).collect())))
    assert got == sorted(map(repr, [(1, 1, 2), (1, 1, 2), (2, 1, 2), (None, None, 0), (None, None, 0)]))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 0)], "doc_id long, quality int, score int")
    model = quality.fit(df, labels, F.col("doc_id") > 0)
    scored = quality.score(df.withColumn("score", F.lit("x")), model)
    assert scored.columns == ["doc_id", "score"] and scored.count() == 5 and scored.filter("score between 0 and 1").count() == 5
    assert quality.accepted(df, model, 0.0).count() == 5 and quality.score(df.limit(0), model).count() == 0 and quality.accepted(df.limit(0), model).count() == 0
    spoken = language.fit(df, F.col("k") >= 0)
    assert language.identify(df, spoken).count() == 5 and language.identify(df.limit(0), spoken).count() == 0 and language.accepted(df.limit(0), spoken).count() == 0


def test_main_text_of_a_long_page(spark):
    body = "".join(f"<p>Paragraph {i} of a long page.</p>" + "<aside>buy this</aside>" * (i % 5) for i in range(20_000))
    pages = spark.createDataFrame([(1, "u", f"<nav>x</nav><article>{body}</article>"), (1, "u", f"<nav>x</nav><article>{body}</article>")], "page_id long, url string, html string")
    got = main_text.extract(pages).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].text == "\n".join(f"Paragraph {i} of a long page." for i in range(20_000))


def brute_spans(length, window, surge):
    """Surge: a line with text that no stretch holds yet and whose window has enough; dive: the first line whose window has nothing."""
    out, i = [], 0
    while i < len(length):
        if length[i] and sum(length[i : i + window]) >= surge:
            j = i
            while j < len(length) and sum(length[j : j + window]) > 0:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def test_spans_by_definition():
    for _ in range(500):
        length = [rnd.choice([0, 0, 0, 3, 20, 60]) for _ in range(rnd.randint(0, 25))]
        window, surge = rnd.randint(1, 4), rnd.choice([1, 25, 40])
        got = [(a, max(k for k in range(a, b) if length[k])) for a, b in main_text.spans(length, window, surge)]
        assert got == [(a, max(k for k in range(a, b) if length[k])) for a, b in brute_spans(length, window, surge)], (length, window, surge)


def test_pages_without_a_marked_article(spark, sf):
    """The block path alone gives the same texts."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert main_text.main_text(r.html.replace("<article", "<div").replace("</article", "</div")) == main_text.main_text(r.html)


# language models ----------------------------------------------------------------------------------------------------


def brute_kneser_ney(counts, order, context, char):
    """Interpolated Kneser-Ney by its definition over strings, for one language. Words lie between boundaries; counts are of words."""
    edge = chr(language.BOUNDARY)
    texts = [(edge + w.decode() + edge, c) for w, c in counts.items()]
    characters = {c for t, _ in texts for c in t}

    def grams(n):
        out = {}
        for t, c in texts:
            for i in range(1, len(t)):
                if i + 1 >= n:
                    g = t[i + 1 - n : i + 1]
                    begins = i + 1 == n  # nothing to its left
                    out.setdefault(g, [0, set()])
                    if n == order or begins:
                        out[g][0] += c
                    elif i + 1 > n:
                        out[g][1].add(t[i - n])
        return {g: x + len(left) for g, (x, left) in out.items()}

    p = 1 / (len(characters) + 1)
    for n in range(1, min(order, len(context) + 1) + 1):
        table = grams(n)
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        history = context[len(context) - n + 1 :]
        own = {g: v for g, v in table.items() if g[:-1] == history}
        if own:
            total = sum(own.values())
            p = max(own.get(history + char, 0) - d, 0) / total + min(1.0, d * len(own) / total) * p
    return p


def test_kneser_ney_by_definition():
    counts = {"a": {b"abc": 3, b"abd": 2, b"b": 5, b"cab": 1}, "b": {b"xyz": 1, b"zy": 4, b"abx": 2}}
    m = language.KneserNey.fit(counts, order=3)
    edge = chr(language.BOUNDARY)
    for w in (b"abc", b"abx", b"zz", b"q", b"cabd", b"b"):
        text = edge + w.decode() + edge
        for j, lang in enumerate(m.languages):
            want = [-np.log(brute_kneser_ney(counts[lang], 3, text[max(0, i - 2) : i], text[i])) for i in range(1, len(text))]
            assert m.losses([w])[0, 1 + j] == pytest.approx(sum(want), rel=1e-5), (w, lang)


def test_kneser_ney_shares_out_all_mass():
    counts = {"a": {b"abc": 3, b"abd": 2, b"b": 5}, "b": {b"xyz": 1, b"zy": 4}}
    for lang, own in counts.items():
        seen = sorted({c for w in own for c in w.decode()} | {chr(language.BOUNDARY)})
        for context in ("", chr(language.BOUNDARY), "a", "ab", "zy"):
            total = sum(brute_kneser_ney(own, 3, context[-2:], c) for c in [*seen, "?"])  # one place for all unknown characters
            assert total == pytest.approx(1.0, abs=1e-9), (lang, context)


FOREIGN = [
    "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес", "素早い茶色の狐がのろまな犬を飛び越えて森へ走って行きました", "A gyors barna róka átugorja a lusta kutyát és elfut az erdőbe a barátaival",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään ystäviensä kanssa", "Szybki brązowy lis przeskakuje nad leniwym psem i ucieka do lasu",
]


def test_rejection_has_both_rates(spark):
    """Planted rows in languages that were not learnt, and junk, are rejected; rows of the learnt ones stay, short and long."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(4)
    junk = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) + " " + " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz0123456789+/") for _ in range(r.randint(4, 16))) for _ in range(40)) for _ in range(30)]
    planted = [(10**9 + i, t, None) for i, t in enumerate([(x + ". ") * 6 for x in FOREIGN] + junk)]
    both = docs.union(spark.createDataFrame(planted, docs.schema))
    kept = {x.doc_id for x in language.accepted(both, language.fit(both, fold("k", 3) != 1)).select("doc_id").collect()}
    rejected = sum(i not in kept for i, *_ in planted) / len(planted)
    learnt = [x.doc_id for x in docs.filter("lang is not null and text rlike '[a-zA-Z]'").select("doc_id").collect()]
    assert rejected >= 0.9 and sum(i in kept for i in learnt) / len(learnt) >= 0.99
