import http.server
import threading

import pytest

from eqloom.sources import fetch
from eqloom.streaming import ingest

PAGE = '<div class="ltx_para" id="S1.p1"><p class="ltx_p">Text.</p><table class="ltx_eqn_table" id="E1"><tr><td><math alttext="a=b"></math><span class="ltx_tag_equation">(1)</span></td></tr></table></div>'


def test_stream_takes_each_file_once(spark, tmp_path):
    cache, out, mark = tmp_path / "cache", str(tmp_path / "out"), str(tmp_path / "mark")
    cache.mkdir()
    (cache / "a_html.html").write_text(PAGE)
    (cache / "empty_html.html").write_text("")
    (cache / "a_abs.html").write_text(PAGE)
    ingest.collect_formulas(spark, str(cache), out, mark).awaitTermination()
    (cache / "b_html.html").write_text(PAGE.replace("a=b", "c"))
    ingest.collect_formulas(spark, str(cache), out, mark).awaitTermination()
    got = sorted((r.paper_id, r.eq_num, r.equation, r.before) for r in spark.read.parquet(out).collect())
    assert got == [("a", "1", "a=b", "Text."), ("b", "1", "c", "Text.")]


def test_pages_come_from_the_cache_then_the_network(spark, tmp_path):
    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200 if "html" in self.path else 404)
            self.end_headers()
            self.wfile.write(b"page")

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "x_1_pdf.pdf").write_bytes(b"kept")
    spark.dataSource.register(fetch.PaperPages)
    read = lambda ids: spark.read.format("paper_pages").options(ids=ids, base=f"http://127.0.0.1:{server.server_port}", cache=str(tmp_path), delay="0", endpoints="html,pdf").load()
    got = {(r.paper_id, r.endpoint): (r.content and bytes(r.content), r.status) for r in read("x/1,y,y").collect()}
    assert got == {("x/1", "html"): (b"page", 200), ("x/1", "pdf"): (b"kept", -1), ("y", "html"): (b"page", 200), ("y", "pdf"): (None, 404)}
    assert sorted(asked) == ["/html/x/1", "/html/y", "/pdf/y"] and (tmp_path / "x_1_html.html").read_bytes() == b"page"
    server.shutdown()
    assert {r.paper_id: r.source for r in fetch.resolve(read("x/1,y")).collect()} == {"x/1": "html", "y": "html"}


def test_robots_and_sources(spark):
    with pytest.raises(ValueError):
        fetch.Pages({"ids": "a", "cache": "/tmp", "endpoints": "src"})
    rows = [("a", "html", b"h", 404), ("a", "pdf", b"p", 200), ("b", "html", None, 0)]
    got = fetch.resolve(spark.createDataFrame(rows, "paper_id string, endpoint string, content binary, status int"))
    assert {r.paper_id: r.source for r in got.collect()} == {"a": "pdf", "b": "none"}
