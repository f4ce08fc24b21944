"""The data source of pages and the live crawl, against a server of this process."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestone.operators import crawl
from lodestone.sources import web

LINKS = {"/": ["/a", "/b", "/gone", "mailto:x@y", "/go"], "/a": ["/b", "/c#x", "/"], "/b": ["https://other.invalid/"], "/c": ["/d"], "/d": [], "/end": ["/late"], "/late": [], "/slow": [], "/big": []}
FAST = web.Manner(delay=0.0, timeout=1.0, most_bytes=5000, retries=0)


def html(path):
    return "<html><body>" + "".join(f'<a href="{u}">x</a>' for u in LINKS[path]) + "</body></html>"


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, time.monotonic()))
            if self.path == "/slow":
                time.sleep(2)
            if self.path == "/go":
                self.send_response(302)
                self.send_header("Location", "/end")
                self.end_headers()
                return
            if self.path not in LINKS:
                self.send_error(404)
                return
            body = b"x" * 6000 if self.path == "/big" else html(self.path).encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except BrokenPipeError:
                pass

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_outcomes_are_rows(spark, server):
    base, _ = server
    urls = [f"{base}/a", f"{base}/nowhere", f"{base}/slow", f"{base}/go", f"{base}/big", "ftp://x/y", "http://127.0.0.1:1/", f"{base}/a"]
    found = web.read_pages(spark, urls, FAST).collect()
    assert {r["url"]: (r["status"], r["error"]) for r in found} == {
        f"{base}/a": (200, None),
        f"{base}/nowhere": (404, "http 404"),
        f"{base}/slow": (None, "timeout"),
        f"{base}/go": (200, None),
        f"{base}/big": (200, "too long"),
        "ftp://x/y": (None, "scheme"),
        "http://127.0.0.1:1/": (None, "connection"),
    }
    assert len(found) == 7
    by_url = {r["url"]: r for r in found}
    assert by_url[f"{base}/go"]["final_url"] == f"{base}/end"
    assert bytes(by_url[f"{base}/a"]["content"]).decode() == html("/a")


def test_one_partition_a_host(spark, server):
    base, _ = server
    other = base.replace("127.0.0.1", "localhost")
    assert web.read_pages(spark, [f"{base}/a", f"{other}/a", f"{base}/b"], FAST).rdd.getNumPartitions() == 2


def test_delay_between_requests_to_a_host(spark, server):
    base, asked = server
    del asked[:]
    rows = spark.createDataFrame([(f"{base}/{p}",) for p in "abcd"] + [(None,)], "url string")
    found = web.fetch(rows, FAST._replace(delay=0.3)).collect()
    assert sorted((r["error"] or "") for r in found) == ["", "", "", "", "scheme"]
    times = sorted(t for _, t in asked)
    assert len(times) == 4 and all(b - a > 0.25 for a, b in zip(times, times[1:], strict=False))


def test_crawl_equals_the_table(spark, server):
    base, _ = server
    live = web.crawl_live(spark, [base + "/"], depth=2, manner=FAST)
    table = spark.createDataFrame([(base + p, html(p)) for p in LINKS if p not in ("/slow", "/big")], "url string, html string")
    expected = {(r["url"].removesuffix("/") or "/", r["depth"]) for r in crawl.crawl(table, [base + "/"], depth=2).collect()}
    fine = {((r["final_url"]).removesuffix("/"), r["depth"]) for r in live.where("error is null").collect()}
    # the table knows no redirect: /go leads to /end, and /late is a link of it
    assert fine - expected == {(base + "/end", 1), (base + "/late", 2)}
    assert expected <= fine
    report = {(r["depth"], r["outcome"]): r["pages"] for r in web.crawl_report(live).collect()}
    assert report == {(0, "ok"): 1, (1, "ok"): 3, (1, "http 404"): 1, (2, "ok"): 2}


def test_page_limit_and_filters(spark, server):
    base, asked = server
    del asked[:]
    found = web.crawl_live(spark, [base + "/"], depth=3, most=3, manner=FAST).collect()
    assert len(found) == 3 and len({p for p, _ in asked}) == 3
    assert sorted((r["depth"], r["url"][len(base) :]) for r in found) == [(0, "/"), (1, "/a"), (1, "/b")]
    found = web.crawl_live(spark, [base + "/"], depth=1, include=["/[ab]$"], exclude=["b$"], manner=FAST).collect()
    assert sorted(r["url"][len(base) :] for r in found) == ["/", "/a"]
