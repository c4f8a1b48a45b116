"""Fingerprints, packing, sharding, mixing, extraction, quality and language identification on small and given tables."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import html, langid, mixing, oph, packing, quality, queries, sharding, sql
from tests.conftest import SMALL

from .test_dedup import WORD, fixture_texts, table


@pytest.fixture(scope="module")
def texts():
    return [*fixture_texts(), "<|endoftext|> and 中文字符 é", "naïve  café\r\n\tx", " non blank", "#$% a|b <c>"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


def ids_of(texts):
    return [7 * i % 1009 for i in range(len(texts))]


# --- fingerprints -------------------------------------------------------------------------------


def test_edited_texts(docs, texts):
    rows = {r.doc_id: r for r in oph.compare_with_next(docs).collect()}
    order = sorted(zip(ids_of(texts), texts, strict=True), reverse=True)
    assert len(rows) == len(order)
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if text == following:
            assert row.near_next == 1
    prints = collections.defaultdict(set)
    for doc, text in order:
        prints[text or ""].add(rows[doc].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_likeness_is_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.8):
        errors = []
        for _ in range(150):
            both, own = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64), int(400 * (1 - share) / 2)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
            true = len(both) / (len(both) + 2 * own)
            same = float(np.mean(oph.sketch(a) == oph.sketch(b)))
            errors.append((same - 2**-8) / (1 - 2**-8) - true)
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def brute_jaccard(a, b, k=oph.SHINGLE):
    shingles = lambda t: {tuple(w[i : i + k]) for w in [WORD.findall(t)] for i in range(max(1, len(w) - k + 1)) if w}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_is_the_jaccard_likeness(spark):
    """Estimated and exact likeness of given texts to their edited texts and to the next one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 20000").collect()]
    rows += [(100_000 + i, rows[0][1] + " tail" * (i % 3)) for i in range(40)]
    got = {r.doc_id: r for r in oph.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, reverse=True)
    errors = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        errors += [got[doc].near_edited - brute_jaccard(text, edited), got[doc].near_next - brute_jaccard(text, following)]
    assert np.max(np.abs(errors)) < 0.2 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_fingerprints_of_a_hot_id(spark):
    """An id that half of the rows share is dealt over several partitions; every row keeps one successor."""
    texts = [f"text {i} of the row" for i in range(120)]
    docs = table(spark, texts + ["same"] * 60, [i if i % 2 else None for i in range(120)] + [None] * 60)
    dealt = [(r.p, r["__bucket"], r["__id"], r["__tail"]) for r in oph.with_next(docs).withColumn("p", F.spark_partition_id()).collect()]
    assert len({p for p, _, doc, tail in dealt if doc == oph.NO_ID and not tail}) > 1
    assert len({(p, b) for p, b, *_ in dealt}) == len({b for _, b, *_ in dealt}) == len({p for p, *_ in dealt})
    rows = oph.compare_with_next(docs).collect()
    assert len(rows) == 180
    assert collections.Counter(r.fingerprint for r in rows) == collections.Counter(oph.packed(oph.sketches([t.encode()])[0]) for t in texts + ["same"] * 60)
    follow = collections.Counter(r.edited_sha256 for r in rows)
    assert len(follow) > 100


def test_fingerprints_of_repeated_and_null_rows(spark):
    same = table(spark, ["a b c", "a b c", None, ""], [5, 5, None, 2])
    rows = oph.compare_with_next(same).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.near_next) for r in rows) == [(False, 2, 1.0), (False, 5, 0.0), (False, 5, 1.0), (True, 0, 0.0)]
    assert oph.compare_with_next(same.limit(0)).count() == 0
    assert oph.compare_with_next(same.where("doc_id = 2")).first().near_next == 1


# --- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("special", [False, True])
def test_packing_is_a_round_trip(docs, texts, special):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = not special
    rows = packing.pack(docs, stretch=4096, special=special).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in zip(ids_of(texts), texts, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.SIZE


def brute_cost(cuts, cost):
    best = {0: 0}
    for end, c in zip(cuts, cost, strict=True):
        best[end] = min(
            best[b] + (0 if (n := end - b) & (n - 1) == 0 and n >= 16 else packing.SIZE - n) + c for b in best if end - b <= packing.SIZE
        )
    return best[cuts[-1]]


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 900, 60))
    sentence = rng.random(ends[-1]) < 0.03
    cuts, cost = packing.boundaries(ends, sentence)
    assert np.diff(cuts, prepend=0).max() <= packing.SPARE
    windows = packing.best_cuts(cuts, cost)
    price = dict(zip(cuts.tolist(), cost.tolist(), strict=True))
    total = 0
    for begin, end in zip([0, *windows], windows, strict=False):
        n = end - begin
        total += price[end] + (0 if n & (n - 1) == 0 and n >= 16 else packing.SIZE - n)
    assert total == brute_cost(cuts.tolist(), cost.tolist())


def test_ids_of_given_texts(spark):
    """The ids of both readings are those of the tokenizers library, on every tenth of the given documents and on odd strings."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 10 = 0").collect()]
    for special in (False, True):
        tokenizer.encode_special_tokens = not special
        for text in [*given, "x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> <|endoftext|>", "<|endof", "\u00a0\u2003 x\r\n\n  y"]:
            assert packing.token_ids(text, path, special).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    assert 50256 in packing.token_ids("x<|endoftext|>y", path, True) and 50256 not in packing.token_ids("x<|endoftext|>y", path)


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0)).count() == 0
    only = packing.pack(table(spark, [None], [None])).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in only] == [(None, 0, 1, 1)]


# --- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    df = spark.range(n).select(sharding.feistel(F.col("id"), F.lit(n).cast("long")).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shards(spark, docs, texts):
    rows = sharding.shard_rows(docs).collect()
    by = {r.doc_id: r for r in rows}
    for doc, text in zip(ids_of(texts), texts, strict=True):
        data = (text or "").encode()
        assert (by[doc].size, by[doc].text_crc32) == (len(data) + 8, zlib.crc32(data))
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    repeated = sharding.shard_rows(table(spark, ["a"] * 60, [None] * 30 + [4] * 30))
    assert sorted(r.position for r in repeated.collect()) == list(range(60))


# --- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), float(sum(sizes.values()))
    while rest:
        total = sum(weight[s] for s in rest)
        full = {s for s in rest if left * weight[s] / total > most * sizes[s]}
        for s in full or rest:
            target[s] = float(most * sizes[s]) if full else left * weight[s] / total
        left -= sum(target[s] for s in full)
        rest = rest - full if full else set()
    return target


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = []
    for source, n in (("a", 400), ("b", 300), ("é", 20), ("z", 3), (None, 40), ("none", 5)):
        for i in range(n):
            words = int(rng.lognormal(3, 1)) if source != "none" else 0
            rows.append((len(rows), " ".join(["w"] * words) if i % 17 else None, source, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    for block in (8192, 300):
        out = mixing.mix(docs, block_rows=block).collect()
        assert len(out) == len(rows)
        sizes, taken, target = collections.Counter(), collections.Counter(), {}
        for r in out:
            assert r.size == len(WORD.findall(rows[r.doc_id][1] or "")) and 0 <= r.taken <= 3 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert {r.source: r.source_size for r in out} == dict(sizes)
        assert target == pytest.approx(brute_targets(sizes))
        for s in target:
            assert abs(taken[s] - target[s]) <= max(25, 0.02 * target[s])
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixing.mix(docs).collect()}
    kept = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert kept == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_null_and_empty_are_two_sources(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, None)] * 3 + [(1, text, "")] * 3 + [(2, None, "a"), (2, "", "a"), (-1, text, "a"), (None, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    assert mixed.select("__key").distinct().count() == 6
    expected = {(r.doc_id, r.source): r.c for r in mixed.groupBy("doc_id", "source").agg(F.sum("copies").alias("c")).collect() if r.c}
    got = {(r.doc_id, r.source): r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id", "source").count().collect()}
    assert got == expected


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    prob, size, draw = rng.random(500), rng.integers(1, 900, 500).astype(float), rng.random(500)
    out = mixing.flight(prob, size, draw)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(prob.sum()) and (out * size).sum() == pytest.approx((prob * size).sum())


def test_inclusion_follows_the_probabilities(spark):
    """Over many seeds a document is drawn as often as its source's rate says, and each draw keeps the number of documents."""
    rng = np.random.default_rng(8)
    n, prob = 60, 0.4
    size = np.maximum(1, rng.lognormal(3, 1, n)).round()
    taken = np.zeros(n)
    for seed in range(600):
        draw = mixing._draws(np.random.default_rng(seed).integers(0, 2**63, n))
        out = mixing.landing(mixing.flight(np.full(n, prob), size, draw), size, draw[::-1])
        out = mixing.repair(out, size, np.ones(n, bool), float(((prob - out) * size).sum()))
        assert abs(out.sum() - prob * n) < 2.01 and set(out) <= {0.0, 1.0}
        assert abs(((out - prob) * size).sum()) <= size.max()
        taken += out
    assert abs(taken.mean() / 600 - prob) < 0.01
    typical = size < np.quantile(size, 0.9)
    assert np.abs(taken[typical] / 600 - prob).max() < 0.12


def test_documents_of_a_source_are_balanced(spark):
    """Documents taken per source come near rate times documents, in blocks and levels."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(1 + rng.lognormal(3, 0.7))), "abc"[i % 7 % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (8192, 500):
        found = mixing.mix(docs, block_rows=block).groupBy("source").agg(
            F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("taken").alias("taken")
        )
        for r in found.collect():
            assert abs(r.copies - r.n * r.target / r["size"]) <= 3
            assert abs(r.taken - r.target) <= 5


def test_mixed_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c d", "t")], "doc_id long, text string, source string")
    total = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(docs).collect()) == total


# --- html ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home, sweet</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="main"><div class="ad">Buy</div><article><h2>Head &amp; line</h2><p>First, a   long\nparagraph, with commas, and <b>bold <p>Second &lt;tag&gt; &#233;<br>line.
<ul><li>One<li>Two</ul><form><p>Sign up, now</p></form><aside>Read more</aside></article>
<section id="comments"><p>Great post, really, thanks, a lot, and more and more words to score.</p></section></div>
<footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE) == "Head & line\nFirst, a long paragraph, with commas, and bold\nSecond <tag> é line.\nOne\nTwo"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "plain", "<div><p>x", "</p></div>", "<script>a", "<!-- x", "<a href='", "&#xZZ;&", "<p>" * 3000 + "deep", "<div>" * 5000 + "deep"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><p class=notice>Cookies<p>First, one.<p>Second.</article><p>Rest", "First, one.\nSecond."),
        ("<main><ul><li class=share>Share<li>Item</ul><p>Rest</main>", "Item\nRest"),
        ("<main><dl><dt class=ad>Buy<dd>Good<dt>Term</dl><p>Rest</main>", "Good\nTerm\nRest"),
        ("<main><table><tr class=promo><td>Buy<tr><td>One<td class=ad>Two<td>Three</table>Rest</main>", "One\nThree\nRest"),
        ("<main><div><div class=ad>Buy</div><aside>Near<p>more</div><p>Rest</main>", "Rest"),
        ("<main><p>One <span class=share>Tweet</p><p>Two</main>", "One\nTwo"),
        ("<main><p class=notice>Cookies<hr>Bare</main>", "Bare"),
        ("<main><div class=ad><svg><path d=x></div><p>Rest</main>", "Rest"),
        ("<main><span>One <nav><b>x</span>y<ul><li>z</ul></li></p></nav>two</span></main>", "One two"),
        ("<main><table><tr><td>One<template><tr><td>x</td></tr></template> two</table></main>", "One two"),
        ("<main><ul><li>One <nav><li>x</nav> two</ul></main>", "One two"),
    ],
)
def test_skipped_elements_without_end_tags(body, text):
    long = "<p>Words, and words, and words, of a paragraph that goes on, for a while.</p>" * 3
    page = f"<head><title>T</title><meta name=x><body>{body}"
    got = html.main_text(page.replace("<main>", f"<main>{long}").replace("<article>", f"<article>{long}"))
    assert got.split("\n")[3:] == text.split("\n")


def test_page_without_article_element():
    long = "words, and words, and again words of a real paragraph that goes on for a while. " * 3
    page = f"<body><div class=sidebar><a href=x>{long}</a></div><div class=wrap><div class=post><p>{long}</p><p>{long}</p></div></div><div class=menu>a</div></body>"
    assert html.main_text(page) == "\n".join([long.strip()] * 2)


@pytest.mark.parametrize("n", [2, 30])
@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>Head</h1><div><section>{}</section><section><p>Short, one.</section></div></article>",
        "<body><h1>Head</h1><div><section>{}</section><section><p>Short, one.</section></div>",
        "<body><div class=nav>Home</div><h1>Head</h1><section>{}</section><section><p>Short, one.</section>",
        "<main><article><h1>Head</h1><div><section>{}</section><section><p>Short, one.</section></div></article><article><a href=x>Next</a></article></main>",
        "<article><h1>Head</h1><div><section>{}</section></div></article><article><p>Short, one.</article>",
        "<body><h1>Head</h1><div><div>{}</div>Short, <b>one</b>.</div>",
        "<body><h1>Head</h1><div><div>{}</div><span>Short, <a href=x>one</a></span>.<ul><li><a href=x>Elsewhere</a></ul></div>",
        "<main><h1>Head</h1><div><article><div>{}</div></article></div><p>Short, one.</main>",
    ],
)
def test_text_beside_the_best_container(page, n):
    """What is kept does not follow the length of the longest section."""
    long = "Words, and words, and words, of a real paragraph that goes on, and on, for a while."
    assert html.main_text(page.format(f"<p>{long}</p>" * n)).split("\n") == ["Head", *[long] * n, "Short, one."]


@pytest.mark.parametrize(
    "name", ["post-comments", "article-comments", "comment-content", "entry-related", "sidebar-content", "main-menu", "commentList", "content__sidebar", "ad content"]
)
def test_names_of_boilerplate(name):
    page = f"<body><div class=content><p>A long enough paragraph, of the page.</p></div><div class='{name}'><p>Not of the page, but long enough too.</p></div>"
    assert html.main_text(page) == "A long enough paragraph, of the page."


@pytest.mark.parametrize("name", ["content has-sidebar", "post-content", "articleBody", "entry-text with_ads"])
def test_names_of_the_body(name):
    assert html.main_text(f"<div class='{name}'><p>A paragraph, of the page.</p></div>") == "A paragraph, of the page."


ARTICLE = "<h1>Head</h1>" + "<p>Words, and words, and words, of a real paragraph that goes on, and on, for a while.</p>" * 4
BESIDE = "<div class=sidebar><p>Near, but not of the page.</p></div><section id=comments><p>A comment, and another one, and so on.</p></section>"


@pytest.mark.parametrize(
    "start",
    [
        "<div class='layout with-sidebar'>", "<div class=has-sidebar>", "<div class='container right-sidebar'>", "<div class='post-12 comments-open'>", "<div class=no-header>",
        "<form action=/x>", "<div class='page-wrap sidebar-left'>", "<div id=header-wrap>", "<form><div class=sidebar-page><div class=menu-page>", "<body class=sidebar-open><div role=banner>",
    ],
)
def test_layouts_named_after_their_parts(start):
    """Elements around the whole article are kept, whatever of the page their names mention."""
    end = "".join(f"</{x}>" for x in ("div", "div", "form"))
    got = html.main_text(f"<body><nav><a href=/>Home</a></nav>{start}{BESIDE}{ARTICLE}{BESIDE}{end}<footer>Contact us, or not</footer></body>")
    assert got == html.main_text(f"<article>{ARTICLE}</article>")


@pytest.mark.parametrize("name", ["mainmenu", "cookiebar", "siteheader", "topbar", "rightsidebar", "adbox", "commentlist", "commentsection", "right-sidebar", "sidebar-left"])
def test_names_in_one_word(name):
    page = f"<body><div class={name}><p>{'Not of the page, but long enough too. ' * 9}</p></div><div class=text>{ARTICLE}</div></body>"
    assert html.main_text(page) == html.main_text(f"<article>{ARTICLE}</article>")


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "ad", "newsletter"])
def test_long_boilerplate_is_never_the_article(name):
    noise = f"<section class={name}>{'<p>Long, and longer, and still going on, without an end.</p>' * 200}</section>"
    assert html.main_text(f"<body><p>Short, one.</p>{noise}</body>") == "Short, one."
    assert html.main_text(f"<body>{noise}</body>") == ""


@pytest.mark.parametrize(
    "page",
    [
        "<article><p data-a=it's>One, two.</p><p title='it is'>Three.</p></article>",
        "<article><p title=\"a > b\" data-x='<b>'>One, two.</p><p class=x/y>Three.</p></article>",
        "<article><p>One, two.</p><p>Three.</p></article><p class=\"ad>Never closed",
        "<article><p a = 'b'c>One, two.</p><p / / x>Three.</p></article><p",
        "<article><p>One, two.<p =x>Three.</article>",
    ],
)
def test_attributes(page):
    assert html.main_text(page) == "One, two.\nThree."


@pytest.mark.parametrize(
    "page",
    ["<span>" * 50_000 + "x" + "<div>" * 50_000, "<div>" * 50_000 + "<li>x</li>" * 50_000, "<div>" * 50_000 + "</b>" * 50_000, "<b><p>x" * 50_000, "<div><p>x, y</p>" * 30_000],
)
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 8


def _made_page(rng):
    """A page of known article blocks among boilerplate, in sloppy mark-up; and the text that it should give."""
    pick = lambda n: " ".join(rng.choice(["stone", "river", "über", "mountain", "a", "tall", "house,", "walks", "naïve", "light."]) for _ in range(n))
    spaced = lambda t: t.replace(" ", rng.choice([" ", "  ", "\n ", "\t"]))
    attr = lambda: rng.choice(["", " class=lead", " title='a > b'", ' data-x="<p>"', " id=it's", " hidden-not=1", ' style="color:red"'])

    def marked(text):
        words = text.split(" ")
        i = rng.randrange(len(words))
        words[i] = rng.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em class=x>{}</em>", "{}<!-- <p>no</p> -->", "<span>{}"]).format(words[i])
        return spaced(" ".join(words))

    truth, body = [], []
    for _ in range(rng.randint(3, 12)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "div", "amp", "table"])
        if kind == "ul":
            items = [pick(rng.randint(3, 9)) for _ in range(rng.randint(1, 4))]
            truth += items
            body.append("<ul>" + "".join(f"<li{attr()}>{marked(x)}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
        elif kind == "amp":
            text = pick(8)
            truth.append(f"{text} & <{text}> é\u2014 \u00a9")
            body.append(f"<p>{text} &amp; &lt;{text}&gt; &eacute;&#8212; &copy;</p>")
        elif kind == "table":
            cells = [pick(4) for _ in range(3)]
            truth += cells
            body.append("<table>" + "".join(f"<tr><td>{c}" + rng.choice(["", "</td></tr>"]) for c in cells) + "</table>")
        else:
            text = pick(rng.randint(12, 40))
            truth.append(text)
            body.append(f"<{kind}{attr()}>{marked(text)}" + (rng.choice(["", "</p>"]) if kind == "p" else f"</{kind}>"))
    names = ["ad", "cookie-notice", "sidebar", "post-comments", "related-posts", "mainMenu", "share", "footer-widget", "newsletter signup"]
    noise = lambda: rng.choice([
        f"<nav><ul><li><a href=/a>{pick(2)}</a></ul></nav>", f"<div class='{rng.choice(names)}'><p>{pick(20)}</p></div>", f"<footer>{pick(9)}</footer>",
        f"<aside>{pick(12)}</aside>", f"<form><p>{pick(5)}<input value='x'></form>", f"<script>if (a < b) document.write('<p>{pick(3)}</p>')</script>",
        f"<style>p > a {{ x: '{pick(2)}' }}</style>", f"<section id={rng.choice(names).replace(' ', '-')}><h3>{pick(3)}</h3><p>{pick(25)}</p></section>",
        f"<!-- {pick(5)} <p> -->", f"<div role=complementary>{pick(8)}</div>", f"<div style='display: none'>{pick(8)}</div>",
    ])
    for _ in range(rng.randint(0, 3)):
        body.insert(rng.randint(0, len(body)), noise())
    holder = rng.choice(["article", "main", "div class=post-content", "div id=content", "section"])
    around = lambda: "".join(noise() for _ in range(rng.randint(0, 4)))
    page = f"<!doctype html><html><head><title>{pick(3)}</title></head><body>{around()}<{holder}>{''.join(body)}</{holder.split()[0]}>{around()}</body></html>"
    return page, truth


@pytest.mark.parametrize("seed", range(150))
def test_made_pages(seed):
    page, truth = _made_page(random.Random(seed))
    assert html.main_text(page).split("\n") == truth


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t")], "page_id int, url string, html string, text string")
    got = sorted(html.extract(pages).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.n_chars == len(r.text), bool(r.text)) for r in got] == [(1, True, True), (1, True, True), (2, True, False)]


# --- quality ------------------------------------------------------------------------------------


def test_base_counts(docs, texts):
    rows = {r.doc_id: r for r in quality.apply_rules(docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})).collect()}
    for doc, text in zip(ids_of(texts), texts, strict=True):
        text = text or ""
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = rows[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.kept and r.base_failed)


def test_fences_follow_the_group(spark):
    clean = [(i, f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(40)), "en", "s") for i in range(150)]
    odd = [(900, " ".join(f"w{j}###" for j in range(60)), "en", "s")]
    rows = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not rows[900].kept and not rows[900].base_failed
    assert all(rows[i].kept for i in range(150))


# --- language -----------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert len(held) > 20 and np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    rows = [(i, f"the cat number{chr(97 + i % 26)} sat", "en", "a") for i in range(40)] + [(100 + i, f"der hund {chr(97 + i % 26)} sitzt", "de", "a") for i in range(40)]
    odd = [(500, None, None, "a"), (501, "", "en", "a"), (502, "12 34 !!", None, "a"), (503, "hund", None, "a"), (503, "hund", None, "a"), (504, "²½", "en", "a")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = collections.defaultdict(list)
    for r in langid.identify_documents(docs).collect():
        got[r.doc_id].append(r.lang_pred)
    assert [got[i] for i in range(500, 505)] == [["und"], ["und"], ["und"], ["de", "de"], ["und"]]
    assert {r.doc_id for r in langid.keep_identified(docs).where("doc_id >= 500").collect()} == {503}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_documents(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("ids", ["null", "one"])
def test_sample_does_not_follow_ids(spark, ids):
    """Null or one repeated id, and copies over the sample's bound: every language is learned and no row is lost."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and text is not null")
    few = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("doc_id", F.lit(None if ids == "null" else 9).cast("long"))
    model = langid.train(few, sample_docs=20)
    assert model.langs == sorted(r.lang for r in docs.select("lang").distinct().collect())
    counts = {r.lang_pred: r["count"] for r in langid.identify(few, model).groupBy("lang_pred").count().collect()}
    assert set(counts) >= set(model.langs)
    kept = langid.keep_identified(few, sample_docs=20).count()
    assert kept > 0.9 * langid.keep_identified(docs, sample_docs=1500).count() * 6 > 0


def test_least_count(spark):
    rows = [(i, "aa", "one two two", None) for i in range(2)] + [(9, "bb", "three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    assert set(langid.train(docs, least_count=1).words) == {"one", "two", "three"}
    assert set(langid.train(docs, least_count=3).words) == {"two"}


def test_languages_of_any_name(spark):
    """Language values are data: backticks, dots, names of the operator's own columns."""
    names = ["a`b", "token", "lang.n", "", "n"]
    words = [["the", "cat"], ["der", "hund"], ["le", "chien"], ["el", "gato"], ["kot", "pies"]]
    docs = spark.createDataFrame([(i, " ".join(words[i % 5] * 3), names[i % 5]) for i in range(200)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == names[r.doc_id % 5] for r in langid.identify_documents(docs).collect())


def test_words_keep_their_marks():
    assert langid._WORDS.findall("हिन्दी भाषा naïve e\u0301te 12ab_c") == ["हिन्दी", "भाषा", "naïve", "e\u0301te", "ab", "c"]


def brute_scores(model, text):
    """Word by word, straight from the definition."""
    words = langid._WORDS.findall((text or "").lower())
    total = np.zeros(len(model.langs))
    for w in words:
        if w in model.words:
            total += model.word_logs[model.words[w]]
            continue
        bounded = f"^{w}$"
        for n in langid.ORDERS:
            every = [bounded[i : i + n] for i in range(len(bounded) - n + 1)]
            known = [model.grams[g] for g in every if g in model.grams]
            if known and (n == 1 or 2 * len(known) >= len(every)):
                total += model.gram_logs[known].mean(axis=0)
                break
    score = total / np.sqrt(len(words)) if words else None
    return ("und", 0.0) if score is None else (model.langs[int(np.argmax(score))], float(np.exp(score - score.max())[np.argmax(score)] / np.exp(score - score.max()).sum()))


def test_scores_are_those_of_the_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    counted = collections.Counter()
    for r in docs.where("doc_id % 2 = 0 and lang is not null and text is not null").collect():
        counted.update(langid._WORDS.findall(r.text.lower()))
    assert set(model.words) == {w for w, n in counted.items() if n >= langid.LEAST_COUNT}
    texts = [r.text for r in docs.where("doc_id % 5 = 1").collect()] + ["xqzw jjj", "", None, "12 3", "the", "éàü ßß"]
    scorer = langid.Scorer(model)
    for text in texts:
        lang, score = scorer.predict(text)
        wanted, near = brute_scores(model, text)
        assert lang == wanted and score == pytest.approx(near, abs=1e-4)


def test_many_texts_at_once(spark):
    """Blocks of hashed words give what single texts give; texts beyond the plain ones go word by word."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), least_count=2)
    odd = [None, "", "12 3", "the", "ÉÀÜ ßß ×a÷b", "a×b", "İstanbul ıI", "e\u0301te ete", "日本語 text", "straße–STRASSE “zitat”", "µ ª º½", "x" * 5000, "zzqqy " * 40, "ŉ Ǆ ƻ ǀ", "a\x00b\u2028c", "ẞ ß"]
    texts = [r.text for r in docs.collect()] + odd
    for t in odd:
        if t and langid._PLAIN.fullmatch(t):
            low = t.lower().encode()
            start, end = langid.letter_spans(np.frombuffer(low, np.uint8))
            assert [low[a:b].decode() for a, b in zip(start, end, strict=True)] == langid._WORDS.findall(t.lower()), t
    one, many = langid.Scorer(model), langid.Scorer(model)
    for text, (lang, score) in zip(texts, many.predict_all(texts), strict=True):
        wanted, near = one.predict(text)
        assert lang == wanted and score == pytest.approx(near, abs=1e-5)
    assert langid.Scorer(langid.Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))).predict_all(["a", None]) == [("und", 0.0)] * 2


# --- the queries' SQL ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(sql.every()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = duck.sql(queries.oracle_sql()[name])
    at = found.columns
    assert sorted(at) == columns
    expected = sorted(([r[at.index(c)] for c in columns] for r in found.fetchall()), key=repr)
    assert sorted(([*r] for r in df.select(*columns).collect()), key=repr) == expected
