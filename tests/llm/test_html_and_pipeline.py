"""Main text of pages, and the pipeline against stage-by-stage plain computations."""

import html
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import html_extract, queries
from plumbline.llm.html_extract import main_text

from ..conftest import SMALL
from .cases import SPACE, sha
from .test_shingle_sets import least_ids

LARGER = SMALL.replace("0.001", "0.01")


def article_of(page):
    """The article of the generated pages, which holds nothing else."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br|div|article|li|ul)\b[^>]*>", body)
    return " ".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)


def test_whole_table_of_pages(spark):
    pages = {x.page_id: x for x in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    got = queries.op5_html_main_text(spark, LARGER).collect()
    assert len(got) == len(pages)
    for x in got:
        assert x.text == article_of(pages[x.page_id].html) and x.n_chars == len(x.text) and x.url == pages[x.page_id].url


@pytest.fixture(scope="module")
def renamed(spark):
    """The pages with their article as a plain div."""
    return spark.read.parquet(f"{LARGER}/pages.parquet").withColumn("html", F.regexp_replace("html", r"(</?)article\b", "$1div"))


def test_rules_find_the_article_without_its_element(spark, renamed):
    want = {x.page_id: article_of(x.html) for x in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    got = {x.page_id: x.text for x in html_extract.extract_main_text(renamed).collect()}
    # Floors: no page loses all, all but a fiftieth of the characters are found, nothing from outside comes in.
    assert all(got.values()) and sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    for k, text in got.items():
        assert not Counter(text.split()) - Counter(want[k].split())


def test_stop_words_decide(spark, renamed):
    with_words, without = (dict(html_extract.extract_main_text(renamed, keep=("page_id",), stop_words=s).select("page_id", "text").collect()) for s in (None, frozenset()))
    assert sum(with_words[k] != without[k] for k in without) > 0.5 * len(without)
    keywords = "bridge repairs closure council committee traffic detour budget contractor engineer inspection hall meeting monday schedule forecast parking lot fee permit archive"
    page = f"<body><div><p>{PROSE * 2}</p><p>{PROSE * 2}</p></div><div>{keywords}</div></body>"
    assert "detour" not in main_text(page) and main_text(page).count(PROSE.strip()) == 4
    assert "detour" in main_text(page, frozenset())


def test_stop_words_are_spread_over_a_page():
    prose = [f"the w{k} of x{k} and " + " ".join(f"y{k}z{j}" for j in range(20)) for k in range("abcdefghijklmnop".__len__())]
    assert html_extract.spread_words(p.replace("0", "a").replace("1", "b") for p in prose) >= {"the", "of", "and"}
    assert html_extract.spread_words([]) == html_extract.spread_words(["a few words once"]) == frozenset()
    # A subject of one paragraph is no stop word, however often that repeats it.
    assert "bridge" not in html_extract.spread_words(["bridge " * 25, *("other words of the hall " * 5 for _ in range(40))])


def test_a_page_gives_the_same_alone_and_among_others(spark, renamed):
    some = renamed.where("page_id < 50")
    others = spark.range(100_000, 105_000).selectExpr("id AS page_id", "'u' AS url", "concat('<body><p>the of and a to in that it is was for', repeat(concat(' word', id), 20), '</p></body>') AS html")
    alone, among = (dict(html_extract.extract_main_text(t, keep=("page_id",)).where("page_id < 50").select("page_id", "text").collect()) for t in (some, some.unionByName(others)))
    assert alone == among and len(alone) == some.count() and all(main_text(x.html) == alone[x.page_id] for x in some.collect())


def test_a_language_of_few_pages_keeps_its_text():
    polish = "Komisja zebrała się w ratuszu w poniedziałek i postanowiła, że stary most zostanie zamknięty na czas remontu, który potrwa co najmniej trzy miesiące."
    page = f"<body><nav><a href=x>Start</a></nav><h1>Most zamknięty</h1><p>{polish}</p><p>{polish}</p><footer>Redakcja</footer></body>"
    for words in (None, frozenset(), frozenset(("the", "of", "and"))):
        assert main_text(page, words) == f"Most zamknięty {polish} {polish}"


@pytest.mark.parametrize("part", ["<a ", "<script ", "<script>", "<div>", "<div class=ad>", '<a href="', "<a x='", "<", "<!--", "<![CDATA[", "</div>", "<b><i>", "<p title='>'>", "&amp", "<p>x"])
def test_time_grows_with_the_length(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < (2 if part.startswith("<a") else 6)


PROSE = "This is the main text of the page and it has many of the words that are in all of the texts of the kind. "


def test_blocks_around_an_article_go():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home of the site</a></nav><div class="cookie-notice">{PROSE}</div>
    <div class=content><h1>Head&amp;line</h1><p>{PROSE}<p>{PROSE} &lt;b&gt; caf&eacute; &#8212; end<br>next<ul><li>short item</li></ul><p>{PROSE}</div>
    <aside>{PROSE}</aside><form><p>{PROSE}</p></form><section id="comments"><p>{PROSE}</p></section><script>var a = "<p>{PROSE}</p>";</script><!-- {PROSE} --><footer>{PROSE}</footer></body></html>"""
    text = main_text(page)
    assert text.count(PROSE.strip()) == 3 and "café — end" in text and "<b>" in text and "Head&line" in text and "short item" in text
    assert "Home" not in text and "var a" not in text


def test_short_blocks_take_the_label_of_their_neighbours():
    links = "<p>" + "<a href=x>one link of many in the list of the site</a> " * 5 + "</p>"
    page = f"<body>{links}<p>Stray</p>{links}<p>{PROSE * 2}</p><p>And so.</p><p>{PROSE * 2}</p></body>"
    text = main_text(page)
    assert "And so." in text and "Stray" not in text and "link" not in text


TOWN = "The committee met in the town hall on Monday and it was decided that the old bridge should be closed for repairs, which will take at least three months."


def test_a_name_that_says_what_stands_beside_drops_nothing():
    page = f'<body class="sidebar"><div class="content-with-sidebar"><div class="post has-comments"><p>{TOWN}</p></div><div class="right sidebar"><p>Other {TOWN}</p></div></div>'
    assert html_extract.main_text(page) == TOWN


TEASER = '<article class="card"><h3><a href=x>Other story</a></h3><p>Read the other story of the day</p></article>'
MAIN = f"<p>{TOWN}</p>" * 3
COMMENT = "I was in the hall on that evening and it was not at all as it has been told here, as all of us who were there know."


@pytest.mark.parametrize("page", [
    f"<body><div>{MAIN}</div>{TEASER}</body>",
    f"<body><div>{MAIN}</div>{TEASER * 6}</body>",
    f"<body><article>{MAIN}</article><div class=related-posts>{TEASER * 6}</div></body>",
    f"<body><main>{MAIN}{TEASER * 3}</main></body>",
    f"<body><div class='layout sidebar-right'><article>{MAIN}</article></div><div><p>{COMMENT}</p></div></body>",
    f"<body><form id=aspnet><div>{MAIN}</div></form></body>",
])
def test_one_article_element_does_not_decide_for_the_page(page):
    assert main_text(page) == f"{TOWN} {TOWN} {TOWN}"


@pytest.mark.parametrize("n", [1, 12, 13, 60, 400])
@pytest.mark.parametrize("layout", [
    "<body><div>{main}</div><section id=comments>{comments}</section></body>",
    "<body><article>{main}<section class='comments-area'>{comments}</section></article></body>",
    "<body><article>{main}</article><ol class='comment-list'>{articles}</ol></body>",
    "<body><div>{main}</div>{named}</body>",
    "<body><article>{main}{named}</article></body>",
    "<body><article>{main}{articles}</article></body>",
])
def test_reader_comments_go_however_many(layout, n):
    parts = {"main": MAIN, "comments": f"<p>{COMMENT}</p>" * n, "articles": f"<article><p>{COMMENT}</p></article>" * n, "named": f"<article class=comment-body><p>{COMMENT}</p></article>" * n}
    assert main_text(layout.format(**parts)) == f"{TOWN} {TOWN} {TOWN}"


def test_a_list_of_articles_and_a_page_of_comments_alone():
    assert main_text("<body>" + f"<article><p>{TOWN}</p><p>{TOWN}</p></article>" * 5 + "</body>") == " ".join([TOWN] * 10)
    assert main_text(f"<body><div class=comment><p>{TOWN}</p></div></body>") == TOWN


@pytest.mark.parametrize("name", ["notice-of-works", "tags-intro ad-free", "gradient loading", "header-less", "non-commented"])
def test_a_part_of_a_name_drops_nothing(name):
    assert main_text(f'<body><article><div class="{name}"><p>{TOWN}</p></div></article></body>') == TOWN


@pytest.mark.parametrize("name", ["layout sidebar-right", "page-header-fixed", "cookies"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_a_name_is_not_believed_of_what_holds_the_text(name, inner):
    assert main_text(f'<body><div class="{name}"><nav><a href=x>Home</a></nav><{inner}><p>{TOWN}</p><p>{TOWN}</p></{inner}></div></body>') == f"{TOWN} {TOWN}"
    assert main_text(f"<body><form><p>{TOWN}</p></form></body>") == TOWN


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "post-comments", "commentList", "site-footer", "related-posts", "newsletter-signup", "sidebar left", "share-buttons"])
def test_names_of_what_stands_around_drop_it(name):
    for mark in ("article", "div"):
        page = f'<body><{mark}><p>{TOWN}</p><div class="{name}"><p>Other words that the town and the hall have for it.</p></div><p>{TOWN}</p></{mark}></body>'
        assert main_text(page) == f"{TOWN} {TOWN}"


def test_a_sentence_with_a_link_stays():
    page = f"<body><article><h1>Bridge</h1><p>{TOWN}</p><p>See <a href=x>the other report of the bridge</a></p><p>{TOWN}</p></article></body>"
    assert main_text(page) == f"Bridge {TOWN} See the other report of the bridge {TOWN}"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text of the page that is not so short as the others are"), (4, "u", "<" * 3000), (5, "u", "plain words"), (5, "u", "plain words"), (6, "u", f"<article><p>{PROSE * 3000}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == 7 and all(x.n_chars == len(x.text) for x in got)
    assert {x.text for x in got if x.page_id in (1, 2)} == {""} and max(x.n_chars for x in got) == len(PROSE) * 3000 - 1
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).persist()
        state[name] = docs
        if name != "tokens":
            assert docs.columns == before.columns
    text = lambda name: {x.doc_id: x.text for x in state[name].collect()}
    good, exact, near = text("quality"), text("exact"), text("near")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 5}
    assert sum((i in good) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    best = {}
    for i, t in good.items():
        key = SPACE.sub("", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert set(exact) == {i for _, i in best.values()}
    ids = sorted(exact)
    # Five-word shingles of a similarity of 0.8 or more, whatever their fingerprints.
    assert set(near) == {ids[k] for k in least_ids([exact[i] or "" for i in ids])}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    mixed = state["mix"].groupBy("doc_id").count().collect()
    assert {x.doc_id for x in mixed} <= set(near)
    want = sorted((x.doc_id, len(sp.encode(near[x.doc_id] or "")), sha(",".join(map(str, sp.encode(near[x.doc_id] or ""))))) for x in mixed for _ in range(x["count"]))
    got = sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in state["tokens"].collect())
    assert got == want
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in corpus_pipeline.run(spark, SMALL).collect()) == got


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, PROSE * 3, "en", None, 5), (5, PROSE * 3, None, "a", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for name, some in (("odd", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
        assert (out.count() == 0) == (not some) or name == "odd"
