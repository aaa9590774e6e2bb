"""Sources and sinks: CSV, XLSX (stdlib-made workbooks), payload JSON, lists, lexicons."""
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from revlens.functions.lexicons import JSON_LEXICON
from revlens.sources import payload, reviews as src


def test_csv_roundtrip_quotes_newlines_na(spark, tmp_path):
    p = tmp_path / "up.csv"
    p.write_text('Reviews,Other\n"He said ""hi""\nthen left",x\nNA,y\n"plain",\n', encoding="utf-8")
    df = src.read_reviews(spark, str(p))
    rows = {r["Other"]: r["Reviews"] for r in df.collect()}
    assert rows == {"x": 'He said "hi"\nthen left', "y": None, None: "plain"}
    assert src.stringify(df).count() == 2
    assert "nan" in [r[0] for r in src.stringify(df, keep_nulls_as_nan=True).select("Reviews").collect()]


def test_missing_reviews_column(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("Text\nabc\n")
    with pytest.raises(ValueError):
        src.read_reviews(spark, str(p))
    with pytest.raises(ValueError):
        src.read_reviews(spark, str(tmp_path / "x.txt"))


def make_xlsx(path, rows):
    shared = []
    def idx(s):
        if s not in shared:
            shared.append(s)
        return shared.index(s)
    cells = []
    for r, row in enumerate(rows, start=1):
        cs = "".join(f'<c r="{chr(65 + c)}{r}" t="s"><v>{idx(v)}</v></c>' for c, v in enumerate(row) if v is not None)
        cells.append(f'<row r="{r}">{cs}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" '
                   'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')
        sis = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{sis}</sst>")


def test_xlsx_many_workbooks(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    make_xlsx(d / "a.xlsx", [["Reviews", "Author"], ["Clean room", "A"], ["Rude staff", None]])
    make_xlsx(d / "b.xlsx", [["Author", "Reviews"], ["C", "Cheap and quick"]])
    df = src.read_reviews_xlsx(spark, str(d))
    got = sorted((r["Reviews"], r["Author"]) for r in df.collect())
    assert got == [("Cheap and quick", "C"), ("Clean room", "A"), ("Rude staff", None)]


def test_payload_files(spark, tmp_path):
    d = tmp_path / "payloads"
    d.mkdir()
    (d / "St%20Mary.json").write_text(json.dumps({"data": [{"reviews_data": [
        {"author_title": "A", "review_text": "good"}, {"author_title": "B"}]}]}))
    (d / "Empty.json").write_text(json.dumps({"data": []}))
    (d / "None.json").write_text(json.dumps({"status": "x"}))
    for layout in payload.LAYOUTS:
        out = payload.read_review_payloads(spark, str(d), layout).orderBy("pos").collect()
        assert [(r["hospital_name"], r["pos"], r["author"], r["reviews"]) for r in out] == \
            [("St Mary", 0, "A", "good"), ("St Mary", 1, "B", None)]
        api = payload.read_review_payloads(spark, str(d), layout, api_variant=True).orderBy("pos").collect()
        assert [r["reviews"] for r in api] == ["good", ""]
    # One empty payload among others is an error when asked for.
    with pytest.raises(Exception, match="holds no data"):
        payload.read_review_payloads(spark, str(d), strict=True).collect()


def test_payload_null_and_missing_text(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"data": [{"reviews_data": [
        {"review_text": None, "rating": 5, "extra": {"a": [1]}}, {"author_title": "x"}, {"review_text": "t"}]}]}))
    out = payload.read_review_payloads(spark, str(tmp_path), api_variant=True).orderBy("pos").collect()
    assert [r["reviews"] for r in out] == [None, "", "t"]


def test_payload_hospital_names(spark, tmp_path):
    names = ["A+ Care", "50% Clinic", "Cl%C3%ADnica", "St Mary", "100%"]
    for n in names:
        (tmp_path / f"{n}.json").write_text(json.dumps({"data": [{"reviews_data": [{"review_text": n}]}]}))
    got = {r["reviews"]: r["hospital_name"] for r in payload.read_review_payloads(spark, str(tmp_path)).collect()}
    assert got == {n: n for n in names} | {"Cl%C3%ADnica": "Clínica"}


def test_payload_trailing_content_is_an_error(spark, tmp_path):
    one = json.dumps({"data": [{"reviews_data": [{"review_text": "a"}]}]})
    (tmp_path / "two.json").write_text(one + "\n" + one + "\n\n")
    assert payload.read_review_payloads(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception):
        payload.read_review_payloads(spark, str(tmp_path), "file").collect()
    (tmp_path / "two.json").write_text(one + " " + one)
    for layout in payload.LAYOUTS:
        with pytest.raises(Exception):
            payload.read_review_payloads(spark, str(tmp_path), layout).collect()
    with pytest.raises(ValueError):
        payload.read_review_payloads(spark, str(tmp_path), "auto")


def test_payload_build_roundtrip(spark, tmp_path):
    rv = src.reviews_from_list(spark, [f"review {i}" for i in range(250)], batch="H+ 5%")
    body = payload.build_payload_json(rv)
    assert body.count() == 3
    path = str(tmp_path / "landed")
    payload.write_payloads(body.coalesce(1), path)  # several payloads in one file
    back = payload.read_review_payloads(spark, path).collect()
    assert sorted(r["reviews"] for r in back) == sorted(f"review {i}" for i in range(250))
    assert {r["hospital_name"] for r in back} == {"H+ 5%"}


def test_xlsx_different_headers_and_na(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    make_xlsx(d / "a.xlsx", [["Reviews", "Author"], ["NA", "A"], ["Rude staff", "n/a"]])
    make_xlsx(d / "b.xlsx", [["Ward", "Reviews"], ["W1", "Cheap"]])
    df = src.read_reviews_xlsx(spark, str(d))
    assert set(df.columns) == {"source_file", "Reviews", "Author", "Ward"}
    got = sorted(((r["Reviews"], r["Author"], r["Ward"]) for r in df.collect()), key=str)
    assert got == sorted([(None, "A", None), ("Rude staff", None, None), ("Cheap", None, "W1")], key=str)
    make_xlsx(d / "c.xlsx", [["Text"], ["no such column"]])
    with pytest.raises(Exception, match="Reviews"):
        src.read_reviews_xlsx(spark, str(d)).collect()


def test_csv_keeps_outer_white_space(spark, tmp_path):
    df = spark.createDataFrame([(" lead", "trail \n")], "Reviews string, Other string")
    src.write_results_csv(df, str(tmp_path / "w"))
    assert tuple(src.read_reviews_csv(spark, str(tmp_path / "w")).first()) == (" lead", "trail \n")


def test_list_source_and_lexicon(spark, tmp_path):
    df = src.reviews_from_list(spark, ["a", None, "b"])
    assert [r["review_id"] for r in df.collect()] == [0, 1, 2]
    p = tmp_path / "lex.json"
    p.write_text(json.dumps(JSON_LEXICON))
    assert list(src.load_lexicon_json(str(p))) == list(JSON_LEXICON)
    lx = src.lexicon_frame(spark, "api")
    assert lx.where("aspect = 'doctor' AND keyword = 'doctor'").count() == 2


def test_results_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', "doctor", "the $T$", "Positive")],
                               "Reviews string, Aspect string, `Formatted Review` string, Sentiment string")
    out = str(tmp_path / "res")
    src.write_results_csv(df, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out).collect()[0]
    assert back["Reviews"] == 'a "q"' and back["Formatted Review"] == "the $T$"


def test_staging_roundtrip_and_full_run(spark, tmp_path):
    from revlens.operators import masking
    from revlens.plans import flow

    rows = [(i, "h1", t) for i, t in enumerate(["The nurses were kind", "The Doctor was rude; doctors ok",
                                                "Clean ICU, room access was slow", None])]
    rows += [(10 + i, "spam", "great " * 10 + "hospital") for i in range(6)]
    df = spark.createDataFrame(rows, "review_id long, batch string, reviews string")
    staged = str(tmp_path / "staged")
    src.write_staging(df, staged)
    back = spark.read.parquet(staged)
    assert sorted(back.columns) == sorted(df.columns) and back.count() == df.count()

    paths = flow.run_and_write(spark, back, str(tmp_path / "out"))
    gate = {r["batch"]: r for r in spark.read.parquet(paths["batch_spam"]).collect()}
    assert gate["spam"]["is_spam"] and not gate["h1"]["is_spam"]
    roll = spark.read.parquet(paths["aspect_rollup"])
    assert roll.count() == 6 and {r["batch"] for r in roll.collect()} == {"h1"}
    res = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(
        paths["sentiment_results"])
    assert res.columns == masking.EXPORT_COLUMNS
    assert res.count() > 0 and res.where("Reviews LIKE 'great%'").count() == 0


def test_empty_export_keeps_schema(spark):
    from revlens.operators import masking
    from revlens.plans import flow

    df = spark.createDataFrame([(1, "b", "no keyword here at all")], "review_id long, batch string, reviews string")
    out = masking.export_frame(masking.masked_rows(flow.score_reviews(df)))
    assert out.columns == masking.EXPORT_COLUMNS and out.count() == 0


def test_usage_flows(spark, tmp_path):
    """The README's usage examples, run end to end."""
    from revlens.operators import masking, scoring
    from revlens.plans import flow

    # E1: an uploaded file is one batch
    up = tmp_path / "upload.csv"
    up.write_text("Reviews,Stars\nThe nurses were kind,5\n\"Bad service, worst staff\",1\nNA,3\n", encoding="utf-8")
    df = src.with_review_id(src.read_reviews(spark, str(up))).withColumn("batch", F.lit("upload"))
    res = flow.analyze(df, text_col="Reviews")
    assert res.gate.collect()[0]["is_spam"] is False
    assert res.rollup.count() == 6
    export = masking.export_frame(res.masked)
    assert export.columns == masking.EXPORT_COLUMNS and export.count() >= 2

    # E2: landed provider payloads, one batch per hospital
    d = tmp_path / "landed"
    d.mkdir()
    body = {"data": [{"reviews_data": [{"author_title": "A", "review_text": "Clean ICU, room access was slow"},
                                       {"author_title": "B", "review_text": "Hospitals nearby are cheap"}]}]}
    (d / "City%20Care.json").write_text(json.dumps(body), encoding="utf-8")
    rv = src.with_review_id(payload.read_review_payloads(spark, str(d))).withColumnRenamed("hospital_name", "batch")
    res2 = flow.analyze(rv)
    assert {r["batch"] for r in res2.rollup.collect()} == {"City Care"}

    # E3: batch predict over a list of texts
    got = scoring.predict(src.reviews_from_list(spark, ["The nurses were kind", "rs"])).collect()
    assert got[0]["staff"] != "" and got[1]["staff"] == "" and got[1]["cost"] != ""


def test_payload_files_are_written_by_all_partitions(spark, monkeypatch):
    from revlens.plans import queries
    from conftest import SF0001

    parts = []
    write = payload.write_payloads
    monkeypatch.setattr(payload, "write_payloads", lambda df, path: (parts.append(df.rdd.getNumPartitions()), write(df, path)))
    held = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        queries.q_payload_files(spark, SF0001)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts == [9]


def test_xlsx_cells(tmp_path):
    """Phonetic readings, cells without a reference, truth values, dates, escapes."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "odd.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                                      '<sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>病院</t><rPh sb="0" eb="2"><t>ビョウイン</t></rPh></si>'
                                           '<si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/>'
                                    '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c></row>'
                   '<row><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>2.5</v></c><c r="F2"><v>7</v></c></row>'
                   '<row><c t="inlineStr"><is><t>a_x000B_b _x005F_x0041_</t></is></c><c t="str"><v>x</v></c><c/></row></sheetData></worksheet>')
    assert src.parse_xlsx_first_sheet(p.read_bytes()) == [
        ["病院", "two runs", "True", "False"], ["2023-03-15 00:00:00", "2023-03-15 12:00:00", "2.5", None, None, "7"],
        ["a\x0bb _x0041_", "x", None]]


def test_workbook_bytes_round_trip(spark, tmp_path):
    odd = ["a <b> & \"c\"", " lead", "tab\tnew\nline\r", "_x0041_ \x0b\x01", "日本", "", None]
    rows = [(i, t, i % 2 == 0) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "review_id long, Reviews string, Flag boolean")
    src.write_workbooks(df, str(tmp_path / "w"), ["Reviews", "Flag"], per_workbook=3)
    back = src.workbook_rows(spark.read.parquet(str(tmp_path / "w")), na_tokens=None).collect()
    assert sorted((str(r.Reviews or ""), r.Flag) for r in back) == sorted((t or "", str(f)) for _, t, f in rows)
    assert {r.source_file for r in back} == {"reviews-0.xlsx", "reviews-1.xlsx", "reviews-2.xlsx"}
