import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import mime, models, terms, text


def one(spark, column, **values):
    kinds = {bytes: "binary", str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("v")).first()["v"]


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


@pytest.mark.parametrize("content,name,kind", [
    (b"%PDF-1.4 x", "a.txt", "application/pdf"),
    (b"\x89PNG\r\n\x1a\nrest", "", "image/png"),
    (b"\xff\xd8\xff\xe0", "", "image/jpeg"),
    (b"RIFF\x00\x00\x00\x00WAVE", "", "image/webp"),
    (b"\x00\x00\x00\x18ftypmp42", "", "video/mp4"),
    (b"  \n<!DOCTYPE HTML><p>", "", "text/html"),
    (b"<HTML>", "x.bin", "text/html"),
    (archive(("word/document.xml", "x")), "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (archive(("xl/workbook.xml", "x")), "", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (archive(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", "x")), "", "application/vnd.oasis.opendocument.text"),
    (archive(("a.txt", "x")), "", "application/zip"),
    (b"PK\x03\x04broken", "", "application/zip"),
    (b"DBRep_DrawableShape\n", "", "model/x-brep"),
    ((b"x" * 72 + b"S0000001\n"), "", "model/iges"),
    (b"ISO-10303-21;\nFILE_SCHEMA(('IFC4'));", "", "application/x-ifc"),
    (b"ISO-10303-21;\nFILE_SCHEMA(('AP214'));", "", "model/step"),
    (b'{"type":"CityJSON"}', "", "application/city+json"),
    (b'{"asset":{"version":"2.0"}}', "", "model/gltf+json"),
    (b"solid cube\nfacet normal", "", "model/stl"),
    (b"words", "a.City.JSON", "application/city+json"),
    (b"words", "a.ifczip", "application/x-ifc-zip"),
    (b"words", "notes.md", "text/markdown"),
    (b"words", "noending", "application/octet-stream"),
    (b"", "", "application/octet-stream"),
    (b"#VRML V2.0 utf8", "", "model/vrml"),
    (b"glTF\x02\x00\x00\x00", "", "model/gltf-binary"),
])
def test_mime(spark, content, name, kind):
    assert one(spark, mime.detect(F.col("c"), F.col("n")), c=content, n=name) == kind


def test_mime_of_nulls(spark):
    assert spark.range(1).select(mime.detect(F.lit(None).cast("binary"), F.lit(None).cast("string")).alias("v")).first()["v"] == mime.UNKNOWN


def test_html_to_text(spark):
    page = "<!doctype html><head><title>A &amp; <b>B</b></title><style>p{}</style></head><body><script>var x='</p>';</script><p>One&nbsp;two</p><div>three<br/>four</div><table><tr><td>c</td></tr></table>\n\n\n<p>&eacute;</p></body>"
    assert one(spark, text.html_to_text(F.col("h"), all_entities=True), h=page) == "# A & B\n\nOne\xa0two\nthree\nfour\nc\n\né"
    assert one(spark, text.html_to_text(F.col("h")), h="<p>&amp;lt;</p>") == "&lt;"
    assert one(spark, text.html_to_text(F.col("h")), h="<script>x</script>  ") is None
    assert one(spark, text.html_to_text(F.col("h")), h="") is None


def test_readable(spark):
    page = "<html><head><title>no</title></head><title>T</title><p> a <b>b</b></p><svg><text>x</text></svg>c &lt;"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(text.readable("h").alias("r")).select("r.*").collect()
    assert (row[0]["title"][-1], row[0]["text"]) == ("T", "a b c <")
    assert tuple(row[1]) == ("", "")


def test_entities_that_do_not_end_can_stay(spark):
    page = "<title>a &&&amp</title><p>&amp;lt; &lt;b &amp</p>&#39;&#39 &"
    row = spark.createDataFrame([(page,)], "h string").select(text.readable(text.ended_entities(F.col("h"))).alias("r")).select("r.*").first()
    assert tuple(row) == ("a &&&amp", "&lt; <b &amp '&#39 &")


def test_addresses_beside_letters_with_accents(spark):
    assert one(spark, text.redact_pii(F.col("t")), t="cióngm.24@mail6.example.coméa") == "ció[redacted-email]éa"


@pytest.mark.parametrize("before,after", [
    ("mail a.b@c.org now", "mail [redacted-email] now"),
    ("call (555) 123-4567 or +1 555.123.4567", "call [redacted-phone] or [redacted-phone]"),
    ("ssn 123-45-6789", "ssn [redacted-ssn]"),
    ("card 1234 5678 9012 3456", "card [redacted-card]"),
    ("é555-123-4567 x", "é555-123-4567 x"),
    ("555 123 4567", "[redacted-phone]"),
    ("see https://x.org/12345 and 1234567890", "see https://x.org/12345 and 1234567890"),
    ("", ""),
])
def test_pii(spark, before, after):
    assert one(spark, text.redact_pii(F.col("t")), t=before) == after


def test_pii_of_null(spark):
    assert spark.range(1).select(text.redact_pii(F.lit(None).cast("string")).alias("v")).first()["v"] == ""


def test_table_to_markdown(spark):
    rows = [[["a|b", None], ["x\ny "], None, ["1", "2", "3"]]]
    df = spark.createDataFrame([rows, [[]], [None]], "r array<array<string>>")
    out = [r["v"] for r in df.select(text.table_to_markdown(F.col("r")).alias("v")).collect()]
    assert out == ["| a\\|b |  |  |\n| --- | --- | --- |\n| x y |  |  |\n| 1 | 2 | 3 |", "", ""]


def test_dedupe(spark):
    assert one(spark, text.dedupe(F.col("a"), 2), a=[" x ", "", "y", "x", "z"]) == ["x", "y"]


def test_names(spark):
    assert one(spark, text.safe_name(F.col("n")), n=' ..a/b<c>:"d|?*\x01. ') == "abcd"
    assert one(spark, text.safe_path(F.col("n")), n="a\\b//../c ") == "/a/b/c"
    assert [one(spark, text.report_name(F.col("n")), n=n) for n in ("r.HTML", "r.htm", "r.docx", "r", "r.txt", "")] == ["r.docx", "r.docx", "r.docx", "r.docx", "r.txt.docx", ""]
    assert one(spark, text.report_location(F.col("n"), F.lit("x")), n="a//b/") == "/a/b/x.docx"
    assert one(spark, text.slug(F.col("n")), n="--Héllo World!--") == "h-llo-world"
    assert one(spark, text.schema_name(F.col("n")), n="a-b.c") == "tenant_a_b_c"
    assert one(spark, text.schema_name(F.col("n")), n="") == "tenant_default"


def test_report_markers(spark):
    said = 'x [[SAVE_REPORT path="/a" file="f.html" title="T"]]\nBody\n[[/save_report]] y [[ save_report ]] [[/SAVE_REPORT]] [[SAVE_REPORT filename="g"]] rest ]] open'
    found = one(spark, text.report_markers(F.col("t")), t=said)
    assert [tuple(r) for r in found] == [("/a", "f.html", "T", "Body", True), ("/", "g", "", "rest ]] open", False)]
    assert one(spark, text.strip_report_markers(F.col("t")), t=said) == "x \nBody\n y    rest ]] open"


def test_html_forms(spark):
    assert one(spark, text.looks_like_html(F.col("t")), t="  <H2>x") is True
    assert one(spark, text.looks_like_html(F.col("t")), t="a <p>") is False
    assert one(spark, text.to_html(F.col("t")), t="a < *b*") == "<p>a &lt; <em>b</em></p>"
    assert one(spark, text.html_document(F.lit("T"), F.col("t")), t="<!doctype html>x") == "<!doctype html>x"
    assert "<title>A&amp;B</title>" in one(spark, text.html_document(F.lit("A&B"), F.col("t")), t="<p>x")


def test_markdown_blocks(spark):
    md = "# T\npara one\nstill\n\n- a\n- b\n> q\n\n| a |\n|---|\n\n```py\n# no heading\n\nx\n```\n---\nend"
    found = one(spark, text.markdown_blocks(F.col("t")), t=md)
    assert [r["kind"] for r in found] == ["heading", "paragraph", "list", "quote", "table", "code", "rule", "paragraph"]
    assert found[5]["text"] == "# no heading\n\nx"


def test_window(spark):
    at = lambda o, n, t="x" * 100: one(spark, text.window(F.col("t"), F.lit(o), F.lit(n), most=1000), t=t)
    assert tuple(at("10", "20")) == ("x" * 20, 100, 30, False)
    assert tuple(at("bad", None)) == ("x" * 100, 100, None, False)
    assert tuple(at("200", "5")) == ("", 100, None, True)
    assert len(at("0", "99999", "y" * 5000)["text"]) == 1000


@pytest.mark.parametrize("t", ["aé漢😀" * 3, "", "plain", "漢漢漢"])
def test_byte_cap(spark, t):
    for most in range(1, 30):
        cut = one(spark, text.cap_bytes(F.col("t"), most), t=t)
        assert cut["text"] == t.encode()[:most].decode("utf-8", "ignore")
        assert cut["trimmed"] == (len(t.encode()) > most)


def test_requests(spark):
    tenant = lambda host: one(spark, text.tenant_of(F.lit(None).cast("string"), F.col("h")), h=host)
    assert [tenant(h) for h in ("acme-eu.app.example.com:8080", "www.example.com", "example.com", "")] == ["acme", "default", "default", "default"]
    assert tuple(one(spark, text.editor_type(F.col("n")), n="A.XLSX")) == ("cell", "xlsx")
    assert one(spark, text.editor_type(F.col("n")), n="a.bin") is None
    key = one(spark, text.document_key(F.col("u"), F.lit("v1")), u="x" * 50)
    assert re.fullmatch("x{20}-[0-9a-f]{32}", key) and key != one(spark, text.document_key(F.col("u"), F.lit("v2")), u="x" * 50)
    assert [one(spark, text.should_save(F.lit(k).cast("int"))) for k in (1, 2, 6, None)] == [False, True, True, False]
    assert one(spark, text.effective_roles(F.col("r")), r=["administrators"]) == ["administrators", "tenant_admin"]
    assert one(spark, text.effective_roles(F.col("r"), agent=True), r=["users"]) == ["users"]
    ip = lambda peer, hops, nets: one(spark, text.client_ip(F.lit(peer), F.lit(hops), nets))
    assert ip("10.0.0.1", "1.1.1.1, 2.2.2.2, 10.0.0.9", ["10.0.0.0/8"]) == "2.2.2.2"
    assert ip("9.9.9.9", "1.1.1.1", ["10.0.0.0/8"]) == "9.9.9.9"
    assert ip("9.9.9.9", "1.1.1.1, 2.2.2.2", []) == "1.1.1.1"
    assert [one(spark, text.is_public_address(F.lit(a))) for a in ("8.8.8.8", "127.0.0.1", "10.1.1.1", "x", "::1")] == [True, False, False, False, False]
    assert one(spark, text.fetchable(F.lit("https://a.org/x"), F.array(F.lit("8.8.8.8")))) is True
    assert one(spark, text.fetchable(F.lit("http://a.org/x"), F.array(F.lit("8.8.8.8")))) is False
    lists = [["8.8.8.8", "2001:4860:4860::8888"], ["8.8.8.8", "127.0.0.1"], ["192.168.1.9"], ["169.254.0.1"], ["224.0.0.1"], ["ff02::1"], ["240.0.0.1"], ["0.0.0.0"], ["::ffff:10.0.0.1"], ["::"], [], None, [None], ["8.8.8.8", ""]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, resolved array<string>")
    assert [r[0] for r in df.orderBy("k").select(text.fetchable(F.lit("https://a.org/x"), F.col("resolved"))).collect()] == [True] + [False] * 13
    assert one(spark, text.argument_summary(F.create_map(F.lit("q"), F.lit("z" * 100)))) == "q=" + "z" * 79 + "…"
    assert one(spark, text.conversation_title(F.col("t")), t="  a \n b  ") == "a b"
    assert one(spark, text.conversation_title(F.col("t")), t=" ") == "New chat"


def test_stems():
    wanted = {"running": "run", "flies": "fli", "relational": "relat", "conditional": "condit", "happiness": "happi", "agreed": "agre", "skies": "sky", "generously": "generous", "communication": "communic", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "by": "by", "say": "say", "cats": "cat", "gas": "gas", "kiwis": "kiwi", "national": "nation", "adjustable": "adjust", "electricity": "electr", "controlling": "control", "café": "café"}
    assert {w: terms.stem(w) for w in wanted} == wanted


def test_similarities(spark):
    s = lambda a, b: one(spark, terms.similarity(F.lit(a), F.lit(b)))
    w = lambda a, b: one(spark, terms.word_similarity(F.lit(a), F.lit(b)))
    assert s("word", "two words") == pytest.approx(0.363636, abs=1e-6)
    assert w("word", "two words") == pytest.approx(0.8)
    assert s("", "x") == 0 and w("", "x") == 0 and w("abc", "") == 0 and s("Same", "same") == 1


def test_best_extent_is_best():
    import random

    rng = random.Random(1)
    for _ in range(300):
        wanted = {rng.choice("abcdef") for _ in range(rng.randint(1, 4))}
        there = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        brute = max((len(wanted & set(there[i:j])) / len(wanted | set(there[i:j])) for i in range(len(there)) for j in range(i + 1, len(there) + 1)), default=0.0)
        assert terms.best_extent(wanted, there) == pytest.approx(brute)


def test_headline(spark):
    body = " ".join(f"w{k}" for k in range(100)) + " the running dog " + " ".join(f"v{k}" for k in range(100))
    out = one(spark, terms.headline([terms.stem("run")])(F.col("t")), t=body)
    assert "**running**" in out and len(out.split()) <= 18
    assert one(spark, terms.headline(["zzz"])(F.col("t")), t="only this") == "only this"


def test_model_texts(spark):
    obj = b"# made by X\no Wall\ng Wall\nusemtl brick\nmtllib m.mtl\nv 1 2 3\n#\n"
    assert one(spark, models.obj_text(F.col("c")), c=obj) == "# OBJ mesh\n\n## Comments\n- made by X\n\n## Names\n- Wall\n- brick\n- m.mtl"
    assert one(spark, models.obj_text(F.col("c")), c=b"v 1 2 3") is None
    vrml = b'#VRML V2.0\nDEF Roof Transform {}\nWorldInfo { title "House" info [""] }'
    assert one(spark, models.vrml_text(F.col("c")), c=vrml) == "# VRML model\n\n## Names\n- Roof\n\n## Strings\n- House"
    line = lambda body, letter, n: (body.ljust(72) + letter + f"{n:7d}\n").encode()
    iges = line("A bracket", "S", 1) + line("1H,,1H;,7Hbracket,3H1.5,", "G", 1) + line("x", "D", 1)
    assert one(spark, models.iges_text(F.col("c")), c=iges) == "# IGES CAD model\n\n## Start section\n- A bracket\n\n## Global\n- ,\n- ;\n- bracket"
    las = bytearray(120)
    las[:4], las[24], las[25], las[26:31], las[58:62] = b"LASF", 1, 4, b"SYS-1", b"tool"
    assert one(spark, models.las_text(F.col("c")), c=bytes(las)) == "# Point cloud (LAS 1.4)\nSystem: SYS-1\nSoftware: tool"
    assert one(spark, models.las_text(F.col("c")), c=b"LASF") is None
    assert one(spark, models.stl_text(F.col("c")), c=b"solid part 7\nfacet") == "# STL mesh\nName: part 7"
    assert one(spark, models.stl_text(F.col("c")), c=b"made with Z\0\0" + bytes(80)) == "# STL mesh\nmade with Z"
    assert one(spark, models.stl_text(F.col("c")), c=b"solid \nfacet") is None
    ply = b"ply\nformat ascii 1.0\ncomment by me\nelement vertex 8\nproperty x\nend_header\ncomment not me\n"
    assert one(spark, models.ply_text(F.col("c")), c=ply) == "# PLY mesh\ncomment by me\nelement vertex 8"


GLTF = b'{"asset":{"version":"2.0","generator":"G"},"nodes":[{"name":"A","mesh":0,"children":[1]},{"name":"A","extras":{"note":"hi","n":3}},{}],"meshes":[{"name":"M"}]}'


def test_gltf_and_cityjson(spark):
    wanted = "# glTF model\nGenerator: G\n\n## Names\n- A\n- hi\n- M"
    assert one(spark, models.gltf_text(F.col("c")), c=GLTF) == wanted
    binary = b"glTF" + (2).to_bytes(4, "little") + (0).to_bytes(4, "little") + len(GLTF).to_bytes(4, "little") + b"JSON" + GLTF + b"\0\0"
    assert one(spark, models.gltf_text(F.col("c")), c=binary) == wanted
    assert one(spark, models.gltf_text(F.col("c")), c=b"not json") is None
    df = spark.createDataFrame([("f", GLTF)], "file_uid string, content binary")
    nodes = sorted(tuple(r)[1:] for r in models.gltf_nodes(df).collect())
    assert nodes == [(0, "A", "Mesh", "A", None), (1, "A-1", "Node", "A", "A"), (2, "node-2", "Node", "node-2", None)]
    city = b'{"type":"CityJSON","metadata":{"title":"Town","referenceSystem":"EPSG:1"},"CityObjects":{"b1":{"type":"Building","attributes":{"name":"Hall","floors":3}},"p1":{"type":"BuildingPart","parents":["b1","x"]}}}'
    assert one(spark, models.cityjson_text(F.col("c")), c=city) == "# CityJSON model\ntitle: Town\nreferenceSystem: EPSG:1\n\n## City objects\n- b1 — Building — name: Hall\n- p1 — BuildingPart"
    rows = sorted(tuple(r)[1:] for r in models.city_nodes(spark.createDataFrame([("f", city)], "file_uid string, content binary")).collect())
    assert rows == [("b1", "Building", "Hall", None), ("p1", "BuildingPart", "p1", "b1")]


def test_part21(spark):
    ifc = rb"""ISO-10303-21;
HEADER; /* a ; comment */
FILE_DESCRIPTION(('View ''x'''),'2;1');
FILE_NAME('house.ifc','2020',('Ann'),(''),'','','');
FILE_SCHEMA(('IFC4'));
ENDSEC; DATA;
#1=IFCWALL('guid','\X2\00C4\X0\u\X\DFen;wall',$,'/* kept */');
#2= IFCDOOR('Door');
#3=IFCWALL('guid','Two');
ENDSEC;"""
    step = b"ISO-10303-21;\nFILE_SCHEMA(('AP214'));\n#1=PRODUCT_DEFINITION('part','',#2);"
    df = spark.createDataFrame([("i", ifc), ("s", step), ("n", b"nothing"), ("e", b"ISO-10303-21;")], "file_uid string, content binary")
    found = dict(tuple(r) for r in models.part21_text(df).collect())
    assert found == {
        "i": "# IFC model (schema IFC4)\n\n## Document\n- View 'x'\n- 2;1\n- house.ifc\n- 2020\n- Ann\n\n## IfcWall\n- guid\n- Äußen;wall\n- /* kept */\n- Two\n\n## IfcDoor\n- Door",
        "s": "# STEP CAD model (schema AP214)\n\n## Product definition\n- part",
    }


def test_chunks_are_cut_a_few_files_at_a_time(spark):
    """More files than a slice has; the chunks go on as they are cut, none of them as an array of a whole batch."""
    from sparkfolio.operators import chunking

    texts = [None if k % 7 == 0 else "\n\n".join(f"{k} " + "x" * 500 for _ in range(k % 5)) for k in range(450)]
    cut = chunking.chunk(spark.createDataFrame(list(enumerate(texts)), "file_uid long, content_md string"))
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    wanted = [(k, n, part) for k, t in enumerate(texts) for n, part in enumerate(chunking.fold(t))]
    assert sorted(tuple(r) for r in cut.collect()) == wanted
