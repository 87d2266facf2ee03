import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pagelode.functions.text import analyze_word
from pagelode.operators import crawl, index, query, rank, report
from pagelode.sources import store
from pagelode.streaming import incremental

NOW = datetime(2020, 1, 1, tzinfo=UTC)
PAGES = [
    (1, "http://h/1", "<title>Apple Pie</title>apple apple banana <a href='/2'>x</a>"),
    (2, "http://h/2", "<title>Banana</title>banana cherry"),
    (3, "http://h/3", "cherry cherry apple"),
]


@pytest.fixture(scope="module")
def built(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return index.build_index(index.parse_pages(pages, NOW))


@pytest.mark.parametrize(
    ("text", "terms", "phrases"),
    [
        ("a b", ("a", "b"), ()), ('"a b" c', ("a", "b", "c"), ("a b",)), ('x"y"z', ("x", "y", "z"), ("y",)),
        ('""', ("",), ("",)), ('"a b', ("a b",), ()), ("  ", (), ()), ("a\tb", ("a\tb",), ()),
    ],
)
def test_lexer(text, terms, phrases):
    assert query.parse(query.lex(text)) == query.ParsedQuery(terms, phrases)


def test_ranking_example(built):
    rows = [tuple(r) for r in rank.search(built, "apple cherry", analyze_word).collect()]
    assert [r[0] for r in rows] == [1, 3, 2]
    for r, want in zip(rows, [(0.707107, 0.707107, 3.464823, 0.584963), (0.948683, 0, 0.948683, 0.654008), (0.707107, 0, 0.707107, 0.584963)], strict=True):
        assert all(math.isclose(a, b, abs_tol=2e-5) for a, b in zip((r[1], r[2], r[3], r[4]), want, strict=True))


def test_phrases_and_empty_results(built):
    assert [r[0] for r in rank.search(built, '"cherry apple"', analyze_word).collect()] == [3]
    for nothing in ('"cherry pie"', "zzz", '"the"', ""):
        assert rank.search(built, nothing, analyze_word).count() == 0


def test_index_tables(built, spark, tmp_path):
    assert built.links.count() == 1 and built.urls.count() == 3
    store.write_index(built, str(tmp_path / "i"))
    back = store.read_index(spark, str(tmp_path / "i"))
    assert rank.search(back, "apple", analyze_word).count() == 2
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    again = store.index_pages(pages, str(tmp_path / "j"), crawl_time=NOW)
    assert again.postings.count() == built.postings.count()
    words = {r.content: r.word_id for r in back.words.collect()}
    assert {r.word for r in back.postings.collect()} == set(words)
    assert sorted(words.values()) == list(range(1, len(words) + 1))


def test_summary_and_pages_of_results(built, spark, tmp_path):
    pages = built.pages.join(built.urls.withColumnRenamed("content", "url"), "url_id")
    links = built.links.join(built.urls, "url_id").selectExpr("page_id", "content AS target")
    block = report.summary(pages, built.postings, links).filter("page_id = 1").first()["block"]
    assert block.split("\n")[0:2] == ["Apple Pie", "http://h/1"] and "appl 3" in block and block.endswith("http://h/2")
    report.write_summary(report.summary(pages, built.postings, links), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).filter(f"value = '{report.RULE}'").count() == 2
    page = report.result_page(rank.search(built, "apple cherry", analyze_word), 2, 2).collect()
    assert [(r["rank"], r["page_id"], r["n_pages"]) for r in page] == [(3, 2, 2)]


def test_bfs(spark):
    edges = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("a", "s", 0), ("a", "c", 1), ("b", "c", 0), ("b", "m", 1)], "source string, target string, ordinal int")
    seeds = spark.createDataFrame([("s", 0)], "node string, ordinal int")
    got = [r["node"] for r in crawl.bfs(edges, seeds).orderBy("visit").collect()]
    assert got == ["s", "a", "b", "c", "m"]
    assert crawl.bfs(edges, seeds, budget=2).count() == 2


def test_bfs_follows_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(66)], "source long, target long, ordinal int").coalesce(1)
    got = [tuple(r) for r in crawl.bfs(edges, spark.createDataFrame([(0, 0)], "node long, ordinal int")).orderBy("visit").collect()]
    assert got == [(i, i, i + 1) for i in range(67)]


def test_newer_versions_replace(spark):
    parse = lambda rows, t: index.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), t)
    old = parse([(1, "u", "one")], datetime(2020, 1, 2, tzinfo=UTC))
    for day, want in ((1, "one"), (2, "one"), (3, "two")):
        fresh = parse([(2, "u", "two")], datetime(2020, 1, day, tzinfo=UTC))
        assert incremental.merge(old, fresh).first()["plaintext"] == want


def test_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(src)
    for _ in range(2):
        incremental.index_stream(spark, src, state, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert incremental.read_state(spark, state).count() == 3


def test_long_words_and_addresses_go_to_quarantine(spark):
    far = "http://h/" + "p" * 2100
    html = f"<title>{'t' * 256}</title>short {'w' * 255} {'x' * 300} <a href='{far}'>l</a><a href='/ok'>k</a>"
    pages = spark.createDataFrame([(1, "http://h/1", html, {"Content-Length": "²"}), (2, "http://h/2", "a", {"Content-Length": " 77 "}), (3, "http://h/3", "abc", None)], "page_id long, url string, html string, headers map<string,string>")
    parsed = index.parse_pages(pages, NOW)
    assert [r["size"] for r in parsed.orderBy("page_id").collect()] == [len("short ") + 255 + 1 + 300 + 1 + len("\nl\nk"), 77, 3]
    one = index.build_index(parsed)
    assert {(r["page_id"], r["field"], len(r["value"])) for r in one.rejected.collect()} == {(1, "title", 256), (1, "plaintext", 300), (1, "link", len(far))}
    assert {len(r["word"]) for r in one.postings.filter("page_id = 1 AND field = 'plaintext'").collect()} >= {5, 255} and one.links.count() == 1


def test_incremental_index(spark, tmp_path):
    """Batches equal a build over the winners; ids are kept, and words that no page holds any more stay."""
    day = lambda n: {"Last-Modified": f"Sun, {n:02d} Nov 2020 00:00:00 GMT"}
    schema = "page_id long, url string, html string, headers map<string,string>"
    batches = [
        [(1, "http://h/1", "apple apple banana <a href='/2'>x</a>", day(5)), (2, "http://h/2", "<title>Banana</title>banana cherry", day(5))],
        [(3, "http://h/1", "older", day(1)), (4, "http://h/2", "equal", day(5)), (5, "http://h/5", "cherry <a href='/1'>b</a><a href='/9'>c</a>", day(5))],
        [(6, "http://h/1", "date cherry <a href='/5'>x</a>", day(9))],
    ]
    table = incremental.IncrementalIndex(spark, str(tmp_path / "i"))
    parse = lambda rows: index.parse_pages(spark.createDataFrame(rows, schema), NOW)
    counts, ids = [], []
    for i, rows in enumerate(batches):
        for _ in range(2):  # a batch that is added again replaces itself
            n = table.add(parse(rows), i)
        counts.append(n)
        now = table.read()
        ids.append({r["content"]: r["url_id"] for r in now.urls.collect()} | {"w:" + r["content"]: r["word_id"] for r in now.words.collect()})
    assert counts == [2, 1, 1] and all(a.items() <= b.items() for a, b in zip(ids, ids[1:], strict=False))
    assert sorted(v for k, v in ids[-1].items() if not k.startswith("w:")) == list(range(1, 5)) and "w:appl" in ids[-1]
    once = index.build_index(parse([r for b in batches for r in b]))
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(now.postings) == rows_of(once.postings) and rows_of(store.named_links(now)) == rows_of(store.named_links(once))
    assert [r[0] for r in rank.search(now, "cherry", analyze_word).collect()] == [r[0] for r in rank.search(once, "cherry", analyze_word).collect()] != []
    src = str(tmp_path / "in")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(src)
    incremental.search_stream(spark, src, str(tmp_path / "s"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert incremental.IncrementalIndex(spark, str(tmp_path / "s")).read().pages.count() == 3


def test_history_kept_beside_an_index(spark, tmp_path):
    path = str(tmp_path)
    assert query.history(spark, path).count() == 0
    for q in ("apple pie", "", "apple tart", "cherry", "apple pie"):
        query.remember(spark, path, q)
    assert [r["query"] for r in query.history(spark, path).collect()] == ["apple pie", "apple tart", "cherry", "apple pie"]
    query.compact_history(spark, path)
    assert [r["query"] for r in query.completions(query.history(spark, path), "app").collect()] == ["apple pie", "apple tart"]


def test_cards(built, spark):
    pages = store.addressed_pages(built)
    cards = {r["page_id"]: r for r in report.result_cards(pages, rank.search(built, "banana", analyze_word), built.postings, store.named_links(built)).collect()}
    assert (cards[2]["rank"], cards[2]["inlinks"], cards[1]["outlinks"]) == (1, "http://h/1", "http://h/2")
    assert cards[2]["time"] == "2020-01-01T00:00:00+00:00" and cards[2]["keywords"] == "banana 2; cherri 1"


def test_history(spark):
    h = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "a")], "user string, seq int, query string")
    assert query.merge_history(h).first()["query"] == "a b a"
    assert query.delete_from_history(h, "a").count() == 2


def test_folding_is_that_of_str(spark):
    chars = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", query.fold(F.col("c")).alias("f")).collect()
    assert [r["c"] for r in got if r["f"] != r["c"].casefold() and r["c"].lower() != r["c"].casefold()] == []
    assert spark.createDataFrame([("Straße ΣΑΣ ﬁ",)], "c string").select(query.fold(F.col("c"))).first()[0] == "strasse σασ fi"


def test_asked_words(built):
    rows = [tuple(r) for r in rank.idf_of(built, ["appl", "none", "cherri"]).orderBy("place").collect()]
    assert [r[2] for r in rows] == [2, 0, 2] and rows[1][3] == 0 and math.isclose(rows[0][3], math.log2(1.5))
    cells = rank.tf_matrix(built, built.pages, ["appl", "none"]).collect()
    assert len(cells) == 6 and sum(c["frequency"] for c in cells) == 3
    shown = rank.explain_terms(built, "apple the zzz", analyze_word).orderBy("place", "page_id").collect()
    assert [(r["term"], r["df"], r["page_id"]) for r in shown] == [("apple", 2, 1), ("apple", 2, 3), ("the", 0, None), ("zzz", 0, None)]
    assert rank.explain_terms(built, "", analyze_word).count() == 0


def test_page_links(spark):
    pages = spark.createDataFrame([(1, "u"), (2, "v")], "page_id long, url string")
    links = spark.createDataFrame([(1, "v"), (1, "w"), (2, "u")], "page_id long, target string")
    assert [tuple(r) for r in report.page_links(pages, links).orderBy("page_id").collect()] == [(1, "v", "v\nw"), (2, "u", "u")]


def test_tokens_come_in_batches_of_bounded_size(spark, monkeypatch):
    """A text's tokens are rows from the start: no batch of arrays holds those of all texts of a batch."""
    texts = spark.createDataFrame([(1, "a b. c"), (2, None), (3, ""), (4, " x" * 70_000), (5, "d")], "doc_id long, text string").coalesce(1)
    got = index.token_positions(texts, "doc_id")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.filter("doc_id <> 4").orderBy("doc_id", "n").collect()] == [(1, 1, 0, "a"), (1, 2, 2, "b."), (1, 3, 5, "c"), (5, 1, 0, "d")]
    assert got.filter("doc_id = 4").agg(F.count("*"), F.max("n"), F.max("pos")).first()[:] == (70_000, 70_000, 139_999)
    monkeypatch.setattr(index, "TOKEN_ROWS", 2)
    assert sorted(map(str, index.token_positions(texts.filter("doc_id <> 4"), "doc_id").collect())) == sorted(map(str, got.filter("doc_id <> 4").collect()))


def test_plain_postings_are_made_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "b a, B c3 a b"), (2, None), (3, " .,"), (4, "Öl öl")], "doc_id long, text string")
    got = index.simple_postings(texts, "doc_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.orderBy("doc_id", "word").collect()] == [
        (1, "a", [1, 4], 2, 2 / 3), (1, "b", [0, 2, 5], 3, 1.0), (1, "c3", [3], 1, 1 / 3), (4, "öl", [0, 1], 2, 1.0),
    ]
