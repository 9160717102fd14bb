import pytest

from gristmill import conf
from gristmill.plans import catalog, crawl

SCOPE = conf.Scope(domain="mereford.example")
SCHEMA = "url string, status int, raw struct<url:string,content:binary,headers:map<string,string>>"
WORDS = "alder birch cedar daisy elder furze gorse hazel"


def _url(i):
    return f"https://a.cs.mereford.example/{WORDS.split()[i]}"


def _chain(n):
    page = lambda i: f"<html><body><p>{WORDS.split()[i]} {WORDS}</p><a href='{_url(i + 1)}'>next</a></body></html>".encode()
    return [(_url(i), 200, (_url(i), page(i), {"Content-Type": "text/html"})) for i in range(n)]


@pytest.mark.parametrize(("rounds", "last"), [(None, 5), (2, 2)])
def test_crawl_runs_until_nothing_is_due(spark, rounds, last):
    seeds = spark.createDataFrame([(_url(0),)], "url string")
    how = {} if rounds is None else {"rounds": rounds}
    got = {(r.round, r.url): r.outcome for r in crawl.crawl(spark.createDataFrame(_chain(4), SCHEMA), seeds, scope=SCOPE, **how).collect()}
    assert got == {(i + 1, _url(i)): "page" if i < 4 else "missing" for i in range(last)}


def test_query_starts_from_answered_urls(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_chain(2), SCHEMA).write.parquet(str(tmp_path / "responses.parquet"))
    monkeypatch.setattr(catalog, "frontier_state", lambda s, d: s.createDataFrame([], "url string, completed boolean"))
    got = {(r.round, r.url, r.outcome) for r in catalog.crawl_rounds(spark, str(tmp_path)).collect()}
    assert got == {(1, _url(0), "page"), (1, _url(1), "page"), (2, _url(2), "missing")}


@pytest.fixture
def server():
    """A cache server with a chain of three pages and links that are not taken."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    bodies = {url: raw[1] for url, _, raw in _chain(3)}
    bodies[_url(2)] += b"<a href='https://elsewhere.example/x'>out</a><a href='/file.pdf'>file</a><a href='/birch/'>again</a>"
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = parse_qs(urlsplit(self.path).query)["q"][0]
            asked.append(url)
            body = bodies.get(url)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(body or b"no")

        def log_message(self, *args):
            pass

    running = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield running.server_port, asked
    running.shutdown()


def test_driver_goes_on_where_it_stood(spark, tmp_path, server):
    from gristmill.plans import driver
    from gristmill.sources import pagelog

    port, asked = server
    config = conf.CrawlConfig("tester", "127.0.0.1", port, [_url(0)], time_delay=0.0)
    state = driver.run(spark, config, str(tmp_path / "crawl"), rounds=2, scope=SCOPE)
    assert {(r.url, r.completed) for r in state.collect()} == {(_url(0), True), (_url(1), True), (_url(2), False)}
    state = driver.run(spark, config, str(tmp_path / "crawl"), scope=SCOPE)
    # The fourth page is missing; each URL is asked for once in spite of the stop between.
    assert {r.url for r in state.where("completed").collect()} == {_url(i) for i in range(4)} and state.where("not completed").count() == 0
    assert sorted(asked) == sorted(_url(i) for i in range(4))
    assert pagelog.read(spark, str(tmp_path / "crawl/log")).count() == 3
    told = {r.url: r.verdict for r in spark.read.parquet(str(tmp_path / "crawl/rejects")).collect()}
    assert told == {"https://elsewhere.example/x": "out-of-scope", "https://a.cs.mereford.example/file.pdf": "bad-extension", "https://a.cs.mereford.example/birch/": "seen"}
