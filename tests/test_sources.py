"""Scanning and extracting a folder tree that must not change."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.sources import extract as X
from lodestar.sources import files as S
from lodestar.streaming import sessions as L


def audit(root):
    return {str(p.relative_to(root)): (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_mtime_ns) for p in root.rglob("*") if p.is_file()}


def ooxml(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus (1)"
    for d in ("notes", "Node_Modules", "sheets"):
        (root / d).mkdir(parents=True)
    (root / "notes" / "a.MD").write_text("# Head\n\nText here.\n\n| a | b |\n| 1 | 2 |\n")
    (root / "notes" / "latin.txt").write_bytes("caf\xe9\n\n\nnext".encode("latin-1"))
    (root / "notes" / "skip.tmp").write_text("x")
    (root / "Node_Modules" / "x.py").write_text("x = 1")
    (root / "main.py").write_text("# c\nx = 1\n")
    (root / "sheets" / "t.csv").write_text("a,b\n,,\n1,\"2,3\"\n")
    (root / "big.txt").write_text("y" * 5000)
    (root / "noext").write_text("z")
    return root


def test_scan_reads_only(spark, tree):
    before = audit(tree)
    none = spark.createDataFrame([], "path string, size long, mtime timestamp_ntz, content_hash string")
    seen, diff = S.scan(spark, str(tree), none, max_bytes=4000, ignore_dirs=("node_modules",), ignore_globs=("*.tmp",))
    rows = {r.path: r for r in seen.collect()}
    assert set(rows) == {"notes/a.MD", "notes/latin.txt", "main.py", "sheets/t.csv", "big.txt", "noext"}
    assert rows["big.txt"].content_hash is None and rows["main.py"].content_hash == hashlib.md5(b"# c\nx = 1\n").hexdigest()
    assert (rows["notes/a.MD"].ext, rows["notes/a.MD"].stem, rows["notes/a.MD"].folder, rows["notes/a.MD"].depth) == (".md", "a", "notes", 1)
    assert {r.change for r in diff.collect()} == {"new"}
    known = seen.select("path", "size", "mtime", "content_hash").cache()
    known.count()
    (tree / "main.py").write_text("# c\nx = 22\n")
    (tree / "noext").unlink()
    before.pop("noext"), before.pop("main.py")
    _, diff = S.scan(spark, str(tree), known, 4000, ("node_modules",), ("*.tmp",))
    change = {r.path: r.change for r in diff.collect()}
    assert change.pop("main.py") == "modified" and change.pop("noext") == "deleted" and set(change.values()) == {"unchanged"}
    assert {k: v for k, v in audit(tree).items() if k != "main.py"} == before


def test_extract(spark, tree):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tree)).select("path", "content")
    docs = {r.path.rsplit("/", 1)[-1]: r for r in X.extract(raw, limit=1000).collect()}
    assert [(b.kind, b.is_tabular, b.is_heading) for b in docs["a.MD"].blocks] == [("heading", False, True), ("paragraph", False, False), ("table", True, False)]
    assert [b.text for b in docs["latin.txt"].blocks] == ["café", "next"]
    assert docs["t.csv"].blocks[0].text == "a | b\n1 | 2,3"
    assert docs["big.txt"].truncated and len(docs["big.txt"].blocks[0].text) == 1000
    assert not docs["noext"].ok and docs["noext"].extractor == "unsupported"
    total = X.report(X.extract(raw)).agg(F.sum("total")).first()[0]
    assert total == 8


W = 'xmlns:w="w"'


def test_office_files():
    word = ooxml(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    d = X.read(word, "x.docx")
    assert [(b["text"], b["is_heading"], b["is_tabular"]) for b in d["blocks"]] == [("Head", True, False), ("Body", False, False), ("a | b", False, True)]
    sheet = ooxml(xl__workbook_xml='<workbook><sheets><sheet name="Plan"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>due</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c><c/></row></sheetData></worksheet>')
    assert X.read(sheet, "x.xlsx")["blocks"][0]["text"] == "Plan\ndue | 3"
    deck = ooxml(ppt__slides__slide1_xml='<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>', ppt__notesSlides__notesSlide1_xml='<p:n xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Say</a:t></a:r></a:p></p:n>')
    assert [b["text"] for b in X.read(deck, "x.pptx")["blocks"]] == ["Title", "Say"]
    assert not X.read(b"not a zip", "x.docx")["ok"] and not X.read(b"%PDF", "x.pdf")["ok"]
    assert X.read(b"", "my_cat-1.png")["blocks"][0]["text"] == "my cat 1"


def test_live_sessions(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{h}:00:00", 1.0) for h in (0, 1, 8)] + [(2, "2024-01-01 00:00:00", 2.0), (1, "2024-01-09 00:00:00", 1.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts AS timestamp) ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = L.live_sessions(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.user_id, r.events) for r in spark.table("live").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
