import io
import json
import zipfile

import pytest

from tallyscope.sources.decks import packages, preflight, scan_findings, scan_objects
from tallyscope.sources.logs import claim_support, read_records, save_reports, split_valid, store_contents
from tallyscope.streaming.chains import EVENT, build_chains, read_events, stream_chains

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def shape(i, text, x=0.05, hidden=False, size=2000):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="Object {i}"{" hidden=" + chr(34) + "1" + chr(34) if hidden else ""}/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{int(x * 1000)}" y="100"/><a:ext cx="500" cy="50"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:rPr sz="{size}"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def deck(slides, more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        ids = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in range(len(slides), 0, -1))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>' for i in range(1, len(slides) + 1)) + "</Relationships>")
        for i, body in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
        for name, content in more:
            z.writestr(name, content)
    return out.getvalue()


def codes(data):
    return {(c, s) for c, s, _ in preflight(data)}


def test_preflight():
    assert codes(deck([shape(2, "x")])) == set()
    assert ("UNSAFE_PATH", "BLOCK") in codes(deck([], [("../evil", "x")]))
    assert ("COMPRESSION_RATIO", "BLOCK") in codes(deck([], [("ppt/big.bin", b"\0" * (2 << 20))]))
    assert codes(deck([], [("ppt/vbaProject.bin", "x")])) == {("ACTIVE_CONTENT", "WARN")}
    assert codes(deck([], [("ppt/slides/_rels/slide1.xml.rels", '<R><Relationship TargetMode="External"/></R>')])) == {("EXTERNAL_LINK", "WARN")}
    assert codes(deck([], [("ppt/x.xml", "<!DOCTYPE a>")])) == {("XML_DECLARATION", "BLOCK")}
    assert codes(b"no zip") == {("NOT_A_PACKAGE", "BLOCK")}
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert {c for c, _ in codes(empty.getvalue())} == {"MISSING_PART"}


def test_deck_scan(spark, tmp_path):
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="9" name="Pic" descr="a chart of sales"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId7"/></p:blipFill></p:pic>'
    media = [("ppt/slides/_rels/slide1.xml.rels", f'<Relationships xmlns="{REL}"><Relationship Id="rId7" Target="../media/a.png"/></Relationships>'), ("ppt/media/a.png", b"png")]
    (tmp_path / "one.pptx").write_bytes(deck([shape(2, "second") + picture, shape(3, "first &amp; title", hidden=True, size=3600)], media))
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    files = packages(spark, str(tmp_path))
    got = scan_objects(files).orderBy("page", "ord").collect()
    assert [(r.page, r.kind, r.text, r.hidden) for r in got] == [(1, "text", "first & title", True), (2, "text", "second", False), (2, "image", "", False)]
    assert got[0].fonts == [36.0] and got[0].x == pytest.approx(0.05) and got[0].w == pytest.approx(0.5)
    assert got[2].alt_text == "a chart of sales" and len(got[2].media_sha256) == 64
    assert [(r.code, r.severity) for r in scan_findings(files).collect()] == [("NOT_A_PACKAGE", "BLOCK")]


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"review_id": "1", "run_id": "a", "verdict": "ACCEPT"}\nbroken\n{"run_id": "b"}\n')
    good, bad = split_valid(read_records(spark, "reviews", str(tmp_path / "r.jsonl")), ["review_id", "run_id"])
    assert [r.review_id for r in good.collect()] == ["1"] and bad.count() == 2
    bundle = {"bundle_id": "b", "claims": [{"claim_id": str(i), "verdict": v, "confidence": 0.5} for i, v in enumerate(["SUPPORTED", "INSUFFICIENT", "REFUTED", "SUPPORTED"])]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    assert tuple(claim_support(read_records(spark, "claims", str(tmp_path / "b.json"), lines=False)).first()) == ("b", 4, 0.5625, 0.5)


def test_sinks(spark, tmp_path):
    store = str(tmp_path / "store")
    first = store_contents(spark, spark.createDataFrame([("a",), ("b",), ("a",)], "content string"), store)
    assert sorted(r.is_new for r in first.collect()) == [True, True]
    again = store_contents(spark, spark.createDataFrame([("b",), ("c",)], "content string"), store)
    assert sorted(r.is_new for r in again.collect()) == [False, True]
    assert spark.read.parquet(store).count() == 3
    reports = spark.createDataFrame([("r1", "d1"), ("r2", "d2")], "run_id string, run_date string")
    save_reports(reports, str(tmp_path / "reports"))
    save_reports(spark.createDataFrame([("r3", "d2")], "run_id string, run_date string"), str(tmp_path / "reports"))
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "reports")).collect()) == ["r1", "r3"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"run{i % 3}", i, f"p{i}") for i in range(30)]
    batch = {tuple(r) for r in build_chains(spark.createDataFrame(rows, EVENT)).collect()}
    for part in range(3):
        (tmp_path / f"{part}.json").write_text("".join(json.dumps(dict(zip(("run_id", "seq", "payload"), r, strict=True))) + "\n" for r in rows[10 * part : 10 * part + 10]))
    import os

    for part in range(3):
        os.utime(tmp_path / f"{part}.json", (1000 + part, 1000 + part))
    stream = stream_chains(read_events(spark, str(tmp_path), per_trigger=1))
    query = stream.writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from chains").collect()} == batch
    finally:
        query.stop()


def test_a_run_is_chained_across_batches(spark):
    from tallyscope.streaming.chains import event_hash

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(f"run{i % 3}" if i % 4 else None, i, f"p{i}") for i in range(100)]
    events = spark.createDataFrame(rows[::-1], EVENT)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        chained = build_chains(events)
        assert "FlatMapGroupsInPandas" not in chained._jdf.queryExecution().toString()
        got = {tuple(r) for r in chained.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    last, want = {}, set()
    for run, seq, payload in rows:
        own = event_hash(last.get(run, ""), run, seq, payload)
        want.add((run, seq, payload, last.get(run, ""), own))
        last[run] = own
    assert got == want


def test_packages_that_cannot_be_read_say_so(spark, tmp_path):
    from tallyscope.sources.decks import deck_texts, media_integrity, page_texts, scan_packages, split_by_digest

    picture = '<p:pic><p:nvPicPr><p:cNvPr id="9" name="Pic"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId7"/></p:blipFill></p:pic>'
    lost = [("ppt/slides/_rels/slide1.xml.rels", f'<Relationships xmlns="{REL}"><Relationship Id="rId7" Target="../media/gone.png"/></Relationships>')]
    files = {
        "good": deck([shape(2, "second") + shape(3, "hidden", hidden=True) + shape(4, ""), shape(2, "first") + shape(3, "too")]), "lost": deck([picture], lost),
        "malformed": deck([shape(2, "x")], [("ppt/slides/slide9.xml", "")])[:-40], "zip": b"no zip", "empty": b"",
        "tag": deck(["<p:sp>"]),
    }
    rows = [(name, data) for name, data in files.items()] + [("null", None)]
    scanned = scan_packages(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: r for r in scanned.collect()}
    assert len(got) == len(rows) and got["good"].findings == [] and len(got["good"].objects) == 5
    for name in ("malformed", "zip", "empty", "null"):
        assert [f.code for f in got[name].findings] == ["NOT_A_PACKAGE"] and got[name].objects == []
    assert [(f.code, f.severity, f.entry) for f in got["tag"].findings] == [("PARSE_FAILED", "BLOCK", "ParseError")]
    objects = scanned.selectExpr("path", "inline(objects)")
    assert {(r.path, r.page, r.text) for r in page_texts(objects).collect() if r.path == "good"} == {("good", 1, "first\ntoo"), ("good", 2, "second")}
    assert {r.path: r.text for r in deck_texts(objects).collect()}["good"] == "first\ntoo\nsecond"
    media = {r.path: (r.status, r.score, r.severity) for r in media_integrity(scanned.where("path in ('good', 'lost')"), objects).collect()}
    assert media == {"good": ("NA", None, "INFO"), "lost": ("SCORED", 0.0, "CRITICAL")}
    named = [(r.path, r.sha256.upper()) for r in got.values() if r.path != "zip"] + [("zip", "0" * 64)]
    good, bad = split_by_digest(scanned, spark.createDataFrame(named[1:], "path string, sha256 string"))
    assert {r.path for r in bad.collect()} == {named[0][0], "zip"} and good.count() == len(rows) - 2 and good.columns == scanned.columns
