"""Crawl, frontier, command line and stream state."""

import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagelode import __main__ as cli
from pagelode.operators import index, numbering
from pagelode.operators.crawl import Frontier
from pagelode.sources import store, web
from pagelode.streaming import incremental

# path: (status, content type, body)
SITE = {
    "/": (200, "text/html", "<title>Seed</title>apple <a href='a'>1</a><a href='/b'>2</a><a href='mailto:x'>m</a>"),
    "/a": (200, "text/html; charset=latin-1", "<title>A café</title>banana <a href='/'>s</a><a href='/c'>c</a><a href='/c'>c</a><a href='a#x'>x</a>"),
    "/b": (200, "application/xhtml+xml", "<title>B</title>cherry <a href='/c'>c</a><a href='/gone'>g</a><a href='/d'>d</a>"),
    "/c": (200, "image/png", "no text"),
    "/d": (200, "text/html", "<title>D</title>apple apple date"),
}


@pytest.fixture(scope="module")
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/")
                self.end_headers()
                return
            status, kind, body = SITE.get(self.path, (404, "text/html", ""))
            data = body.encode("latin-1")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Last-Modified", "Sun, 06 Nov 1994 08:49:37 GMT")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def paths(rows, column, site):
    return [r[column].removeprefix(site) for r in rows]


def test_crawl_is_breadth_first(spark, site):
    pages, failed = web.crawl(spark, [site + "/moved"], budget=10, concurrency=2)
    assert paths(pages.orderBy("page_id").collect(), "url", site) == ["/", "/a", "/b", "/d"]
    assert sorted(paths(failed.collect(), "asked", site)) == ["/c", "/gone"]
    parsed = index.parse_pages(pages, datetime(2020, 1, 1, tzinfo=UTC)).orderBy("page_id").collect()
    assert parsed[1]["title"] == "A café" and parsed[0]["mod_time"].year == 1994


def test_crawl_budget(spark, site):
    assert paths(web.crawl(spark, [site + "/"], budget=2, concurrency=2)[0].orderBy("page_id").collect(), "url", site) == ["/", "/a"]
    assert web.crawl(spark, [site + "/", site + "/b"], concurrency=2)[0].count() == 2


def test_connection_failures_are_tried_again(monkeypatch):
    waits = []
    monkeypatch.setattr(web.time, "sleep", waits.append)
    with pytest.raises(OSError):
        web.fetch("http://127.0.0.1:1/", attempts=3, timeout=1, wait=1)
    assert waits == [1, 2]


def order(df):
    return [r["url"] for r in df.orderBy("place").collect()]


def test_frontier(spark):
    f = Frontier(spark)
    assert f.enqueue(["http://h/a", "http://h/b"]) == 2
    f.enqueue(["http://h/x", "http://h/y"], before=True)
    assert order(f.dequeue(3)) == ["http://h/x", "http://h/y", "http://h/a"]
    with pytest.raises(ValueError, match="scheme"):
        f.enqueue(["ftp://h/a"])
    with pytest.raises(ValueError, match="already"):
        f.enqueue(["http://h/a", "http://h/new"])
    assert f.enqueue(["http://h/a", "http://h/c"], ignore_queued=True) == 1
    f.reset(spark.createDataFrame([("http://h/a",)], "url string"))
    f.enqueue(["http://h/a"])
    assert order(f.dequeue(9)) == ["http://h/b", "http://h/c", "http://h/a"]
    with pytest.raises(LookupError):
        f.dequeue()


def test_numbers_by_ranges(spark):
    rows = numbering.number(spark.range(1000).selectExpr("id", "id % 7 AS k"), ["k", "id"], "n", 10).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(11, 1011))
    assert numbering.number(spark.range(0), ["id"], "n").count() == 0


def test_command_line(spark, site, tmp_path, capsys):
    d = str(tmp_path / "index")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"database_path": d, "keyword_count": 1}))
    cli.run(spark, cli.arguments(["crawl", site + "/", "-n", "4", "-d", d, "-c", "2", "-s", str(tmp_path / "sum")]))
    assert store.read_index(spark, d).pages.count() == 4
    assert spark.read.text(str(tmp_path / "sum")).filter("value = 'D'").count() == 1
    cli.run(spark, cli.arguments(["--config", str(config), "summary"]))
    told = capsys.readouterr()
    assert "appl 2\n" in told.out and "fetched 4 of 4 pages" in told.err and "indexed 4 pages" in told.err
    hits = cli.run(spark, cli.arguments(["search", "-d", d, "apple date", "--explain"])).collect()
    assert [h["title"] for h in hits] == ["D", "Seed"] and hits[0]["inlinks"] == site + "/b"
    assert spark.read.parquet(f"{d}/history").first()["query"] == "apple date"


def test_options_are_written_and_read(tmp_path, capsys):
    path = str(tmp_path / "o.json")
    first = cli.arguments(["--write-config", path, "crawl", "http://h/", "-d", "x", "--index-concurrency", "3", "--no-progress"])
    again = cli.arguments(["--config", path, "crawl", "http://h/"])
    assert (again.database_path, again.index_concurrency, again.no_progress) == ("x", 3, True) == (first.database_path, first.index_concurrency, first.no_progress)
    with pytest.raises(SystemExit):
        cli.arguments(["-v"])
    assert "pagelode 0." in capsys.readouterr().out


def test_a_cancelled_crawl_loses_no_address(spark, site, monkeypatch):
    f = Frontier(spark)
    monkeypatch.setattr(web, "respond", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        web.crawl(spark, [site + "/", site + "/a"], budget=5, frontier=f)
    assert order(f.dequeue(9)) == [site + "/", site + "/a"]


def test_state_of_a_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "page_id long, url string, html string, headers map<string,string>"
    day = lambda n: {"Last-Modified": f"Sun, {n:02d} Nov 2020 00:00:00 GMT"}

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.index_stream(spark, src, state, str(tmp_path / "cp"), schema).trigger(availableNow=True).start().awaitTermination()
        return {r["url"]: r["plaintext"] for r in incremental.read_state(spark, state).collect()}

    assert incremental.read_state(spark, state) is None
    assert add([(1, "u", "one", day(5)), (2, "v", "v", day(5))]) == {"u": "one", "v": "v"}
    assert add([(3, "u", "equal", day(5)), (4, "v", "older", day(1))]) == {"u": "one", "v": "v"}
    incremental.compact(spark, state)
    assert add([(5, "u", "newer", day(9)), (6, "v", "equal", day(5))]) == {"u": "newer", "v": "v"}
    incremental.compact(spark, state)
    incremental.compact(spark, state)
    assert incremental.read_state(spark, state).count() == 2
