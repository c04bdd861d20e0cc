"""Sources, sinks, packaging and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from assayer.sources import html, lines, packaging, sheets, tables
from assayer.streaming import progress


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1}\n\n{"k": 2}\n{"k": 3', encoding="utf-8")
    assert sorted(r.k for r in tables.read_jsonl(spark, str(p), "k long").collect()) == [1, 2]
    assert tables.read_jsonl(spark, str(tmp_path / "none"), "k long").count() == 0
    assert [r.value for r in lines.scan(spark, str(p), "k long")[1].collect()] == ['{"k": 3']
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_jsonl(spark, str(p), "k long", mode="strict").collect()


def workbook(path, sheets, shared=()):
    """A minimal workbook; sheets: name -> rows of XML cells."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")


def test_xlsx(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "ROWS_PER_BATCH", 2)
    text = lambda s, r="": f'<c t="inlineStr"{r}><is><t>{s}</t></is></c>'
    rows = [
        [text("use"), text("query"), text("use"), text("n.x", ' r="E1"')],
        ['<c r="A2" t="s"><v>0</v></c>', '<c r="B2" t="s"><v>1</v></c>', '<c r="C2" t="b"><v>1</v></c>', '<c r="E2"><v>4.5</v></c>'],
        [], ['<c r="A4" t="s"><v>0</v></c>', text(" q 2 ", ' r="B4"'), '<c r="E4" t="e"><v>#N/A</v></c>'],
        [text("no"), text("q3")], ['<c r="A6" t="s"><v>0</v></c>'], ['<c r="A7" t="s"><v>0</v></c>', text("q 2", ' r="B7"')],
    ]
    p = str(tmp_path / "a.xlsx")
    workbook(p, {"first": rows, "none": []}, shared=["<t>yes</t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>x</t></rPh>"])
    got = sheets.read_xlsx(spark, p)
    assert got.columns == ["use", "query", "use.1", "Unnamed: 3", "n.x"]
    assert [tuple(r) for r in got.collect()] == [("yes", "rich", "TRUE", None, "4.5"), ("yes", " q 2 ", None, None, None), ("no", "q3", None, None, None), ("yes", None, None, None, None), ("yes", "q 2", None, None, None)]
    kept = tables.read_table(spark, p, keep="use=yes", required=("query",))
    assert sorted(r["query"] for r in kept.collect()) == ["q 2", "rich"]
    assert sheets.read_xlsx(spark, p, "none", ["query"]).count() == 0 and sheets.read_xlsx(spark, p, "none").columns == []
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_xlsx(spark, p, "other", ["query"]).count()


def test_empty_sink_is_valid(spark, tmp_path):
    tables.write_jsonl(spark.createDataFrame([], "k long"), str(tmp_path / "e"))
    assert tables.read_jsonl(spark, str(tmp_path / "e"), "k long").count() == 0


def test_report_metrics(spark, tmp_path):
    (tmp_path / "r.md").write_text("# x\nclean: 4.64\n", encoding="utf-8")
    assert tables.metrics_from_report(spark, str(tmp_path / "r.md"), {"clean": r"clean: ([0-9.]+)"}).first().clean == 4.64
    with pytest.raises(Exception, match="metric not found"):
        tables.metrics_from_report(spark, str(tmp_path / "r.md"), {"x": r"x: ([0-9.]+)"}).collect()


def test_html():
    text = html.paragraphs_of('<html><script>var t="</p>";</script><p>a &amp; b<br>c</p><img src="x.png"><div>d</div>')
    assert text == "a & b\nc\n<img src=x.png>\nd"


def test_pool_round_trip(spark):
    df = spark.createDataFrame([("p", "c", "g", ["c", "", " s "])], "p string, c string, g string, s array<string>")
    row = packaging.grpo_rows(df, "sys", "p", "c", "g", "s").withColumn("back", packaging.read_pool(F.col("v1_answers_json"))).first()
    assert row.back == ["c", "g", "s"] and row.v1_answer_pool_size == 3
    assert spark.range(1).select(packaging.read_pool(F.lit("plain")).alias("x")).first().x == ["plain"]


def test_sse(spark):
    lines = [("s", 0, 'data: {"reasoning": "a", "content": ""}'), ("s", 1, ": ping"), ("s", 2, 'data: {"content": "b"}'), ("s", 3, "data: [DONE]")]
    row = packaging.sse_text(spark.createDataFrame(lines, "s string, p int, v string"), "v", "s", "p").first()
    assert (row.reasoning, row.content) == ("a", "b")


def test_stream_restart_takes_only_what_is_new(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(10).coalesce(1).write.parquet(src)
    score = lambda d: d.withColumn("ok", F.col("id") % 2 == 0)
    assert progress.run_available(spark, src, "id long", score, out, ck).count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    got = progress.run_available(spark, src, "id long", score, out, ck)
    assert got.count() == 15 and got.select("id").distinct().count() == 15


def test_gather_stops_at_target(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(0, 60).repartition(6).write.parquet(src)
    n = progress.gather(spark, src, "id long", lambda d: d.withColumn("ok", F.lit(True)), str(tmp_path / "o"), str(tmp_path / "c"), "ok", 15)
    assert 15 <= n <= 60


def test_latest_line_and_log(spark, tmp_path):
    (tmp_path / "l.log").write_text("step 1\nnoise\nstep 2\nend\n", encoding="utf-8")
    assert lines.latest_matching(spark, str(tmp_path / "l.log"), "^step").first().value == "step 2"
    assert "| a |" in tables.markdown(spark.createDataFrame([(1,)], "a int"))
