import json

from eqloom.operators import documents as D
from eqloom.sources import papers as P


def test_paper_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("arXiv:2\n\n 1 \nARXIV:2\n3\r\n")
    got = P.paper_list(spark, str(tmp_path / "list.txt")).orderBy("ord").collect()
    assert [x["paper_id"] for x in got] == ["2", "1", "3"]


def test_cache_prefers_html(spark, tmp_path):
    for name, data in (("a_html.html", b"h"), ("a_pdf.pdf", b"p"), ("b_html.html", b""), ("b_pdf.pdf", b"p"), ("c_abs.html", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {x["paper_id"]: (x["source"], bytes(x["content"])) for x in P.cached(spark, str(tmp_path)).collect()}
    assert got == {"a": ("html", b"h"), "b": ("pdf", b"p")}


def test_pdf_equations(spark):
    lines = ["The energy of the system is", "E = mc2   (1)", "where c is the speed", "x   ( 2a )", "again  (1)", "no number (3)", None, ",  (A.4)"]
    df = spark.createDataFrame([("p", 1, i, s) for i, s in enumerate(lines)], "id string, page int, line_no int, line string")
    got = D.pdf_equations(df)
    assert [tuple(x) for x in got.orderBy("eq_ord").select("eq_num", "equation", "before", "after").collect()] == [
        ("1", "E = mc2", lines[0], lines[2]),
        ("2a", "x", lines[2], ""),
        ("A.4", ",", lines[3], ""),  # four words by blanks
    ]
    doc = json.loads(P.to_document(got).first()["json"])
    assert list(doc) == ["1", "2a", "A.4"] and doc["1"] == {"equation": "E = mc2", "source": "pdf", "latex_method": "pdf_text", "context_before": lines[0], "context_after": lines[2]}
    assert D.pdf_equations(df.limit(0)).count() == 0


def test_running_sums_over_ranges(spark):
    rows = [(i, (i * 7) % 5) for i in range(300)]
    got = D.running_before(spark.createDataFrame(rows, "ord long, n long"), "ord", "n").collect()
    assert {r.ord: r.before for r in got} == {i: sum(n for _, n in rows[:i]) for i, _ in rows}


def test_exports_are_read_back(spark, tmp_path):
    papers = spark.createDataFrame([(1, "html"), (2, "none")], "id long, source string")
    frags = spark.createDataFrame([(1, 1, "(2)", None), (1, 0, "(1)", "é\n")], "id long, table_index int, eq_num string, alttext_preview string")
    P.export(P.fragments_document(papers, frags), str(tmp_path / "one"))
    got = {}
    for f in (tmp_path / "one").glob("*.txt"):
        for line in f.read_text("utf-8").splitlines():
            got |= json.loads(line)
    assert got == {"1": {"source": "html", "fragments": [{"table_index": 0, "eq_num": "(1)", "alttext_preview": "é\n"}, {"table_index": 1, "eq_num": "(2)", "alttext_preview": None}]}, "2": {"source": "none", "fragments": []}}
