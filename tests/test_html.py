from eqloom.sources import html as H


def kinds(html, kind):
    cols = [c.split()[0] for c in H.SCHEMA.split(", ")]
    return [dict(zip(cols, r)) for r in H.rows(1, html) if r[1] == kind]


TAG = '<span class="ltx_tag ltx_tag_equation">({})</span>'


def table(cls, body):
    return f'<table class="{cls} ltx_eqn_table">{body}</table>'


def test_standalone_number_in_another_row():
    e = kinds(table("ltx_equation", f'<tr><td>{TAG.format(1)}</td></tr><tr><td><math alttext="a=b"></math></td></tr>'), "equation")
    assert [(x["number"], x["latex"], x["method"]) for x in e] == [("1", "a=b", "alttext")]


def test_group_rows_take_the_row_before():
    body = f'<tr><td><math alttext="a"></math></td></tr><tr><td>{TAG.format("2a")}</td></tr><tr><td><math alttext="c"></math>{TAG.format("2b")}</td></tr>'
    assert [(x["number"], x["latex"]) for x in kinds(table("ltx_equationgroup", body), "equation")] == [("2a", "a"), ("2b", "c")]


def test_shared_number_joins_formulas_and_takes_the_best_method():
    body = '<tr><td><span class="ltx_tag_equationgroup">(5)</span><math alttext="a"></math><math><annotation encoding="application/x-tex">\\displaystyle b</annotation></math></td></tr>'
    e = kinds(table("ltx_equationgroup", body), "equation")
    assert [(x["latex"], x["method"]) for x in e] == [("a \\\\\nb", "annotation")]


def test_unnumbered_and_odd_numbers_are_skipped():
    html = table("ltx_equation", '<tr><td><math alttext="a"></math></td></tr>') + table("ltx_equation", f'<tr><td><math alttext="b"></math>{TAG.format("1&#39;")}</td></tr>')
    assert kinds(html, "equation") == [] and [f["text"] for f in kinds(html, "fragment")] == ["?", "(1')"]


def test_mathml_fold():
    body = f"<tr><td><math><mfrac><mi>α</mi><msub><mi>x</mi><mn>1</mn></msub></mfrac></math>{TAG.format(3)}</td></tr>"
    e = kinds(table("ltx_equation", body), "equation")
    assert (e[0]["latex"], e[0]["method"], e[0]["mi"]) == ("\\frac{\\alpha}{{x}_{1}}", "mathml", ["α", "x_1", "x"])


def test_mathml_of_every_shape():
    say = lambda x: H.mathml(H.tree(f"<math>{x}</math>").kids[0]).strip()
    cases = {
        "<msup><mi>x</mi><mn>2</mn></msup>": "{x}^{2}",
        "<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>": "{x}_{i}^{2}",
        "<mroot><mi>x</mi><mn>3</mn></mroot>": "\\sqrt[3]{x}",
        "<msqrt><mi>x</mi><mo>∂</mo></msqrt>": "\\sqrt{x \\partial}",
        "<mover><mi>x</mi><mo>^</mo></mover><mover><mi>v</mi><mo>→</mo></mover>": "\\hat{x} \\vec{v}",
        "<munder><mi>x</mi><mi>y</mi></munder>": "\\underset{y}{x}",
        "<munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover>": "{\\sum}_{i}^{n}",
        "<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable>": "\\begin{matrix} a & b \\\\ c & d \\end{matrix}",
        "<mi>ħ</mi><mo>\u2062</mo><mspace/><mtext>if so</mtext><mfrac><mi>a</mi></mfrac>": "\\hbar \\, \\text{if so} a",
        "<semantics><mi>a</mi><annotation>x</annotation></semantics>": "a",
    }
    assert {x: say(x) for x in cases} == cases


def test_methods_and_fragments():
    body = f'<tr><td><math alttext="b"><mi>c</mi><annotation encoding="application/x-tex"> a </annotation></math>{TAG.format(3)}</td></tr>'
    page = table("ltx_equation", body) + table("ltx_equation", f'<tr><td><math alttext="{"y" * 130}"></math></td></tr>')
    assert [(m["number"], m["latex"], m["text"], m["before"]) for m in kinds(page, "methods")] == [("3", "a", "b", "c")]
    f = kinds(page, "fragment")
    assert [(x["text"], x["latex"], x["before"], x["method"]) for x in f] == [("(3)", "a", None, "math"), ("?", None, "y" * 120, "math")]
    assert H.tree(f[0]["after"]).kids[0].raw() == H.tree(page).kids[0].raw()


def test_broken_markup():
    t = H.tree("<!doctype html><!-- <p> --><p class=a title='x>y'>1 < 2 &amp; <b>3<p>4<script>if (a<b) '<p>'</script><br/>5</zz><td")
    assert [(n.classes, n.text()) for n in t.walk() if n.tag == "p"] == [(["a"], "1 < 2 & 3 4 5 <td"), ([], "4 5 <td")]
    assert H.tree("").kids == [] and H.tree("plain").raw() == "plain"


def test_paragraphs_links_and_implied_ends():
    html = '<section id="S1"><div class="ltx_para" id="S1.p1"><p class="ltx_p">One<p class="ltx_p">Two <a class="ltx_ref" href="#S1.E1">(1)</a></div><div class="ltx_para"><p class="ltx_p">no id</p></div></section>'
    assert [(p["text"], p["section_id"]) for p in kinds(html, "para")] == [("One Two (1)", "S1")]
    assert [(x["href"], x["before"]) for x in kinds(html, "link")] == [("S1.E1", "Two (1)")]


def test_spot_keeps_the_prose_of_both_sides():
    html = '<section id="S1"><h2 class="ltx_title">Head</h2><div class="ltx_para" id="S1.p1"><p class="ltx_p">A.</p>' + table("x", f'<tr><td><math alttext="a"></math>{TAG.format(4)}</td></tr>').replace("<table", '<table id="S1.E4"') + '<p class="ltx_p">B.</p></div></section>'
    assert [(s["number"], s["before"], s["after"], s["method"], s["title"]) for s in kinds(html, "spot")] == [("4", "A.", "B.", "child", "Head")]


def test_null_page(spark):
    assert H.nodes(spark.createDataFrame([(1, None)], "i long, h string"), "i", "h").count() == 0


def test_equal_attributes_are_read_once():
    a, b, c = H.tree('<p class="x y" id=1>a</p><p class="x y" id=1>b</p><p class="x z" id=1>c</p>').kids
    assert a.attrs is b.attrs and a.attrs == {"class": "x y", "id": "1"} and b.classes == ["x", "y"]
    assert c.classes == ["x", "z"] and (a.raw(), b.raw()) == ("a", "b")
