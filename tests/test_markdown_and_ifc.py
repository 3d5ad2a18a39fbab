"""Markdown as HTML, and object trees of IFC files, against hand-made results."""

import time

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import markdown, models
from sparkfolio.operators import context

CASES = {
    "# Hi *you* **there** #": "<h1>Hi <em>you</em> <strong>there</strong></h1>",
    "a **b *c* d** e": "<p>a <strong>b <em>c</em> d</strong> e</p>",
    "- a\n- b\n  - c\n  - d\n- e": "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n<li>d</li>\n</ul>\n</li>\n<li>e</li>\n</ul>",
    "1. x\n2. y\n\ntext": "<ol>\n<li>x</li>\n<li>y</li>\n</ol>\n<p>text</p>",
    "3) a\n4) b": '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>',
    "- a\n1. b": "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>",
    "```py\nx < 1\n\n# no heading\n```\nafter": '<pre><code class="language-py">x &lt; 1\n\n# no heading\n</code></pre>\n<p>after</p>',
    "~~~\nopen": "<pre><code>open\n</code></pre>",
    "> quote\n> more\n\n---": "<blockquote>\n<p>quote\nmore</p>\n</blockquote>\n<hr />",
    "> - a\n>   b": "<blockquote>\n<ul>\n<li>a\nb</li>\n</ul>\n</blockquote>",
    "snake_case_word _em_ __st__ ***both***": "<p>snake_case_word <em>em</em> <strong>st</strong> <em><strong>both</strong></em></p>",
    "a\\*b\\* `` ` `` <b> & x": "<p>a*b* <code>`</code> &lt;b&gt; &amp; x</p>",
    '[l](http://a.b "t") ![i](p.png)': '<p><a href="http://a.b" title="t">l</a> <img alt="i" src="p.png" /></p>',
    "[x](javascript:alert(1)) [y](JavaScript:1)": "<p>[x](javascript:alert(1)) [y](JavaScript:1)</p>",
    "<https://x.y/?a=1&b>": '<p><a href="https://x.y/?a=1&amp;b">https://x.y/?a=1&amp;b</a></p>',
    "[a *b](u) c*": '<p><a href="u">a *b</a> c*</p>',
    "one  \ntwo": "<p>one<br />\ntwo</p>",
    "| a | b |\n|:--|--:|\n| 1 | a\\|b |\n| 2 |": '<table>\n<thead>\n<tr>\n<th style="text-align: left;">a</th>\n<th style="text-align: right;">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align: left;">1</td>\n<td style="text-align: right;">a|b</td>\n</tr>\n<tr>\n<td style="text-align: left;">2</td>\n<td style="text-align: right;"></td>\n</tr>\n</tbody>\n</table>',
    "* unmatched ** marks _ here": "<ul>\n<li>unmatched ** marks _ here</li>\n</ul>",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert markdown.render(text) == CASES[text]


def test_in_spark(spark):
    df = spark.createDataFrame([("*a*",), (None,), ("x\r\ny",)], "t string")
    assert [r[0] for r in df.select(markdown.markdown_to_html("t")).collect()] == ["<p><em>a</em></p>", "", "<p>x\ny</p>"]


@pytest.mark.parametrize("text", ["*" * 1_000_000, "*a " * 300_000, "a* " * 300_000, "*a _b " * 150_000, "[" * 1_000_000, "[](" * 200_000, "`a" * 300_000, ">" * 1_000_000, "- " * 500_000])
def test_long_runs_of_marks_are_linear(text):
    start = time.perf_counter()
    markdown.render(text)
    assert time.perf_counter() - start < 10


def test_provenance_page_renders_turns_and_sources(spark):
    record = '{"report":{"uid":"r"},"chatted_by":"u","tenant":"t","citations":[{"marker":"1","kind":"web","url":"https://a.b","title":"<T>"},{"marker":2,"file_uid":"abc"},{"marker":"3","kind":"web","url":"javascript:1","title":"bad"}],"transcript":[{"role":"user","content":"**hi** <x>"},{"role":"assistant","content":"<p>made</p>"}]}'
    page = context.provenance_page(spark.createDataFrame([("r", record), ("s", "{}")], "uid string, record string")).orderBy("uid").collect()
    assert '<section class="user"><h2>user</h2><p><strong>hi</strong> &lt;x&gt;</p></section><section class="assistant"><h2>assistant</h2><p>made</p></section>' in page[0]["page"]
    assert '<ul><li>[1] <a href="https://a.b" rel="noopener">&lt;T&gt;</a></li><li>[2] (file abc)</li><li>[3] bad</li></ul>' in page[0]["page"]
    assert "<p>No citations.</p>" in page[1]["page"]


IFC = """ISO-10303-21; HEADER; FILE_SCHEMA(('IFC4')); ENDSEC; DATA;
#1=IFCPROJECT('0000000000000000000001',$,'Tower (''A''); \\X2\\00E9\\X0\\',$,$,$,$,$,$);
#2=IFCSITE('0000000000000000000002',#9,$,$,$,$,$,$,.ELEMENT.,(52,30,0),$,$,$,$);
#3=IfcBuilding('0000000000000000000003',$,'House',$,$,$,$,$,$,$,$,$);
#4=IFCWALL('0000000000000000000004',$,'',$,$,$,$,$); /* #5=IFCWALL('0000000000000000000009',$,'no',$,$,$,$,$); */
#6=IFCRELCONTAINEDINSPATIALSTRUCTURE('0000000000000000000006',$,$,$,(#4, #77),#3);
#7=IFCRELAGGREGATES('0000000000000000000007',$,'a,b',$,#1,(#2));
#8=IFCRELAGGREGATES('0000000000000000000008',$,$,$,#2,(#3,#4));
#9=IFCPROPERTYSET('000000000000000000000A',$,'P',$,(#10));
#10=IFCCARTESIANPOINT((0.,0.));
#11=IFCDOOR('000000000000000000000B',$,'open
ENDSEC; END-ISO-10303-21;"""


def test_an_ifc_tree(spark):
    df = spark.createDataFrame([("f", bytearray(IFC.encode())), ("g", bytearray(b"not one")), ("h", bytearray(IFC.replace("House", "Other").encode())), ("n", None)], "file_uid string, content binary")
    found = models.ifc_objects(df).orderBy("file_uid", "position").collect()
    key = lambda k: f"{'0' * 21}{k}"
    tree = lambda house: [(key(1), "IfcProject", "Tower ('A'); é", None), (key(2), "IfcSite", "IfcSite", key(1)), (key(3), "IfcBuilding", house, key(2)), (key(4), "IfcWall", "IfcWall", key(3))]
    assert [tuple(r)[2:] for r in found if r["file_uid"] == "f"] == tree("House")
    assert [tuple(r)[2:] for r in found if r["file_uid"] == "h"] == tree("Other")
    assert {r["file_uid"] for r in found} == {"f", "h"}


def test_arguments():
    assert models.split_arguments("'a,(b''',$,(1,(2,'x)')),IFCLABEL('y'),.T.)") == ["'a,(b'''", "$", "(1,(2,'x)'))", "IFCLABEL('y')", ".T."]
    assert models.split_arguments("(1,2") is None and models.split_arguments(None) is None and models.split_arguments(")") == [""]
