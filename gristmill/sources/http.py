"""Fetching through a cache server, distributed over partitions, as rows of responses.

``GET http://host:port/?q=<url>&u=<agent>``; bodies are streamed and cut off beyond the size
limit. Failures are rows, not exceptions: too large gives status 700, an empty or undecodable
body the HTTP status, and a failed connection 601. The server's answers must be plain HTTP:
bodies are taken as they are and never unpickled.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill import conf

SCHEMA = "url string, status int, error string, raw struct<url:string,content:binary,headers:map<string,string>>"
TOO_LARGE, NO_ANSWER = 700, 601
_RAW = pa.struct([("url", pa.string()), ("content", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])


def fetch(url: str, config: conf.CrawlConfig, limit: int = conf.MAX_BYTES, timeout: float = 30.0) -> dict:
    query = urllib.parse.urlencode([("q", url), ("u", config.user_agent)])
    failed = {"url": url, "status": NO_ANSWER, "error": None, "raw": None}
    too_large = failed | {"status": TOO_LARGE, "error": f"more than {limit} bytes: {url}"}
    try:
        with urllib.request.urlopen(f"http://{config.host}:{config.port}/?{query}", timeout=timeout) as answer:
            length = answer.headers.get("Content-Length", "")
            if length.isdigit() and int(length) > limit:
                return too_large
            body = answer.read(limit + 1)
            if len(body) > limit:
                return too_large
            if not body:
                return failed | {"status": answer.status, "error": f"empty body: {url}"}
            raw = {"url": url, "content": body, "headers": list(answer.headers.items())}
            return {"url": url, "status": answer.status, "error": None, "raw": raw}
    except urllib.error.HTTPError as e:
        return failed | {"status": e.code, "error": str(e)}
    except (OSError, ValueError) as e:
        return failed | {"error": str(e)}


def responses(urls: DataFrame, config: conf.CrawlConfig, limit: int = conf.MAX_BYTES) -> DataFrame:
    """One row per URL (null URLs are left out); each partition waits ``time_delay`` between its
    requests, so the number of partitions sets the rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                rows.append(fetch(url, config, limit))
                time.sleep(config.time_delay)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["url"] for r in rows], pa.string()),
                        pa.array([r["status"] for r in rows], pa.int32()),
                        pa.array([r["error"] for r in rows], pa.string()),
                        pa.array([r["raw"] for r in rows], _RAW),
                    ],
                    ["url", "status", "error", "raw"],
                )

    return urls.where("url is not null").select("url").mapInArrow(run, SCHEMA)
