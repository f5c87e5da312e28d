import io
import json
import zipfile

from conftest import rows
from pagemill.sources import content_list, html, packages


def archive(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives(spark):
    good = archive({"article.md": "# x", "images/a.png": "p"})
    bomb = archive({"z.bin": b"\0" * (2 << 20)})
    df = spark.createDataFrame([("a", good), ("b", bomb), ("c", b"no zip"), ("d", None), ("e", archive({"../x": "1"}))], "package_id string, content binary")
    got = {(r.package_id, r.path): (r.size, r.problem) for r in packages.archive_entries(df).collect()}
    assert got == {("a", "article.md"): (3, None), ("a", "images/a.png"): (1, None), ("b", "z.bin"): (None, "ratio"), ("c", ""): (None, "not-an-archive"), ("e", "../x"): (1, "invalid-path")}


def test_round_trip(spark):
    df = spark.createDataFrame([("p", "b.md", bytearray(b"x")), ("p", "a/c.md", bytearray(b"y"))], "package_id string, path string, content binary")
    once, again = packages.build_archives(df).first(), packages.build_archives(df.orderBy("path")).first()
    assert once.sha256 == again.sha256 and once.files == 2
    back = packages.archive_entries(packages.build_archives(df).select("package_id", "content"))
    assert {(r.path, bytes(r.content)) for r in back.collect()} == {("b.md", b"x"), ("a/c.md", b"y")}
    assert packages.manifest_rows(df).first().outputs[0].path == "a/c.md"


def test_folder_and_detection(spark, tmp_path):
    for name in ("one/article.md", "one/mineru-result.json", "two/x.md", "two/x_content_list.json", "three/page.html", "four/a.md", "four/b.md", "five/article.md", "six/only.md", "six/README.md", "seven/n.md", "seven/content_list_v2.json"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("# t")
    files = packages.scan_folder(spark, f"file:{tmp_path}")
    got = {r.package_id: (r.format, r.article, r.content_list) for r in packages.detect_source(files).collect()}
    assert got == {
        "one": ("extraction", "article.md", "mineru-result.json"), "two": ("extraction", "x.md", "x_content_list.json"), "three": ("html", "page.html", None), "four": ("unknown", None, None),
        "five": ("article", "article.md", None), "six": ("markdown", "only.md", None), "seven": ("extraction", "n.md", "content_list_v2.json"),
    }
    assert files.filter("package_id = 'one'").count() == 2
    both = spark.createDataFrame([("p", "./A.md"), ("p", "a.md"), ("p", "b.md")], "package_id string, path string")
    assert [(r.key, r.paths) for r in packages.path_collisions(both).collect()] == [("a.md", ["./A.md", "a.md"])]


def test_content_lists(spark):
    flat = [{"type": "text", "text": "a", "page_idx": 1, "bbox": [1, 2, 3, 4]}, "junk", {"type": "image", "image_caption": ["c"], "page_idx": -1, "text_level": "x"}]
    paged = [[{"type": "text", "text": "p"}], [{"type": "text", "page_idx": 7}, {"type": "table"}]]
    df = spark.createDataFrame([("a", json.dumps(flat)), ("b", json.dumps(paged)), ("c", json.dumps([[{"type": "x"}], {"type": "y"}])), ("d", None), ("e", "{}"), ("f", "no"), ("g", "[]")], "doc_id string, json string")
    got = {(r.doc_id, r.source_index): (r.page_idx, r.type, r.text, r.bbox, r.image_caption) for r in content_list.elements(df).collect()}
    assert got == {
        ("a", 0): (1, "text", "a", [1.0, 2.0, 3.0, 4.0], None), ("a", 1): (None, None, None, None, None), ("a", 2): (None, "image", None, None, ["c"]),
        ("b", 0): (0, "text", "p", None, None), ("b", 1): (1, "text", None, None, None), ("b", 2): (1, "table", None, None, None),
        ("c", 0): (None, None, None, None, None), ("c", 1): (None, "y", None, None, None),
    }


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>x</script></head><body><nav>n</nav><article><h1>A &amp; B</h1><p>One <b>bold</b> <a href='https://e.org/(a)'>link</a> <a href='javascript:x'>bad</a><p>Two"
        "<ul><li>x<li>y</ul><img src='i/a%20b.png' alt='z'><img src='https://e.org/c.png' alt='far'><table><tr><th>a<th>b<tr><td>1|2</table><pre>code</pre></article></body></html>"
    )
    md, title, images, blocked = html.html_to_markdown(page, "p/index.html")
    assert title == "T" and images == ["p/i/a b.png"] and blocked == ["https://e.org/c.png"]
    for part in ("# A & B", "One **bold** [link](https://e.org/%28a%29) bad", "Two", "- x\n- y", "![z](p/i/a b.png)", "| a | b |\n| --- | --- |\n| 1\\|2 | |", "```\ncode\n```", "far"):
        assert part in md
    assert "script" not in md and "n\n" not in md
    df = spark.createDataFrame([("a", page), ("b", None), ("c", ""), ("d", "<p>" * 3 + "x" + "<b>" * 120_000)], "doc_id string, source string")
    got = {r.doc_id: (r.markdown is not None, r.problem) for r in html.convert(df).collect()}
    assert got == {"a": (True, None), "c": (True, None), "d": (False, "too many nodes")}
    assert html.local_image("a/b.html", "../../x.png") is None and html.local_image("a/b.html", "../x.png") == "x.png"


def test_jats(spark):
    xml = "<article><front><article-title>T</article-title><abstract><p>Abs.</p></abstract></front><body><sec><title>S</title><p>P <i>q</i></p><sec><title>SS</title><p>x</p></sec></sec></body></article>"
    assert html.jats_to_markdown(xml) == "# T\n\n## Abstract\n\nAbs.\n\n## S\n\nP q\n\n### SS\n\nx" and html.jats_to_markdown("<a>") == ""
    assert rows(html.convert(spark.createDataFrame([("a", xml)], "doc_id string, source string"), "jats"))[0][1].startswith("# T")
