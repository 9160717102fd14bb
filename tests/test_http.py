import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from gristmill import conf
from gristmill.sources import http


class Cache(BaseHTTPRequestHandler):
    def do_GET(self):
        url = parse_qs(urlsplit(self.path).query)["q"][0]
        body = {"http://h/ok": b"<html>x", "http://h/big": b"y" * 100}.get(url, b"")
        self.send_response(404 if url == "http://h/none" else 200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def config():
    server = HTTPServer(("127.0.0.1", 0), Cache)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield conf.CrawlConfig("me", "127.0.0.1", server.server_port, time_delay=0.0)
    server.shutdown()


def test_failures_are_rows(spark, config):
    urls = spark.createDataFrame([("http://h/ok",), ("http://h/big",), ("http://h/empty",), ("http://h/none",), (None,)], "url string")
    got = {r.url: r for r in http.responses(urls, config, limit=50).collect()}
    assert got["http://h/ok"].status == 200 and bytes(got["http://h/ok"].raw.content) == b"<html>x"
    assert got["http://h/ok"].raw.headers["Content-Type"] == "text/html"
    assert got["http://h/big"].status == 700 and got["http://h/empty"].status == 200 and got["http://h/empty"].raw is None
    assert got["http://h/none"].status == 404 and len(got) == 4
    assert http.fetch("http://h/", conf.CrawlConfig("me", "127.0.0.1", 1))["status"] == 601
