import io
import json
import zipfile

from verdigris.sources.listings import listing_pages, listing_rows, snapshot_faults
from verdigris.sources.workbooks import historical_evaluations, read_workbooks, workbook_table

ROW = {"zqdm": "1", "ZQJC": "<u>One</u> &amp; Co", "hymc": " energy "}
LAYOUTS = {
    "rows": {"rows": [ROW], "total": 1}, "data": {"data": [ROW], "metadata": {"recordcount": "1", "pagecount": 1, "pageno": 1}}, "nested": {"data": {"list": [ROW], "totalCount": 1, "page_no": 1}},
    "help": {"pageHelp": {"data": [ROW], "total": 1, "pageNo": 1, "pageCount": 1}, "result": [ROW]}, "list": [{"data": [ROW]}],
}


def found(spark, pages):
    df = spark.createDataFrame(pages, "snapshot string, page int, p string")
    read = listing_pages(df, "p", "page", ["snapshot"]).persist()
    rows = listing_rows(read, "szse", ["snapshot"])
    faults = {}
    for r in snapshot_faults(read, rows, ["snapshot"]).collect():
        faults.setdefault(r.snapshot, set()).add(r.fault)
    return rows.collect(), faults


def test_layouts(spark):
    rows, faults = found(spark, [(name, 1, json.dumps(page)) for name, page in LAYOUTS.items()])
    assert faults == {} and {r.snapshot for r in rows} == set(LAYOUTS)
    assert {tuple(r)[2:] for r in rows} == {("000001.SZ", "One & Co", "energy", "000001.SZ", "上市", None)}


def test_faults_of_snapshots(spark):
    page = lambda rows, total, no, count=1: json.dumps({"data": rows, "total": total, "pageNo": no, "pageCount": count})
    a, b = {"code": "1", "name": "a"}, {"code": "2", "name": "b"}
    _, faults = found(spark, [
        ("whole", 1, page([a], 2, 1, 2)), ("whole", 2, page([b], 2, 2, 2)), ("html", 1, "<html>"), ("null", 1, None), ("empty", 1, json.dumps({"x": 1})), ("echo", 1, page([a], 1, 2)), ("changed", 1, page([a], 2, 1, 2)), ("changed", 2, page([b], 3, 2, 2)),
        ("short", 1, page([a], 2, 1, 2)), ("twice", 1, page([a, a], 2, 1)), ("nameless", 1, page([{"code": "5"}], 1, 1)), ("codeless", 1, page([{"code": "x1", "name": "x"}], 1, 1)), ("scalars", 1, page([1], 1, 1)),
    ])
    assert "whole" not in faults
    assert faults["html"] >= {"not_json"} and faults["null"] >= {"not_json"} and faults["empty"] >= {"no_rows"} and faults["echo"] >= {"page_mismatch"} and faults["scalars"] >= {"no_rows"}
    assert faults["changed"] == {"totals_changed", "row_count_differs"} and faults["short"] == {"pages_incomplete", "row_count_differs"}
    assert faults["twice"] == {"repeated_codes"} and faults["nameless"] == {"no_name"} and faults["codeless"] == {"no_code"}


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows):
    """A workbook with one sheet: texts shared or inline, numbers as values, nulls left out."""
    shared = sorted({c for r in rows for c in r if isinstance(c, str) and len(c) % 2})

    def cell(i, j, c):
        at = f'r="{chr(65 + j)}{i}"'
        if isinstance(c, str):
            return f'<c {at} t="s"><v>{shared.index(c)}</v></c>' if c in shared else f'<c {at} t="inlineStr"><is><t>{c}</t></is></c>'
        return f"<c {at}><v>{c}</v></c>"

    body = "".join(f'<row r="{i}">{"".join(cell(i, j, c) for j, c in enumerate(r) if c is not None)}</row>' for i, r in enumerate(rows, 1))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {NS}><dimension ref="A1"/><sheetData>{body}</sheetData></worksheet>')
    path.write_bytes(data.getvalue())


def test_a_table_of_a_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["证券代码", "证券 简称", None, "x"], ["000001", "One", 7, 2.0], [None, "Two", None, 3.25]])
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = read_workbooks(spark, str(tmp_path)).persist()
    assert [r.fault is None for r in rows.orderBy("file", "row").collect()] == [True, True, True, False]
    got = {r.row: r.fields for r in workbook_table(rows).collect()}
    assert got == {2: {"stock_code": "000001", "company_name": "One", "x": "2"}, 3: {"stock_code": "", "company_name": "Two", "x": "3.25"}}


def line(kind, code, name, numbers, short="abc", total=None):
    return ["1", None, None, "c", "city", code, short, name, kind, *numbers, total]


def test_historical_pairs(spark, tmp_path):
    head = [None] * 6 + ["公司简称", "公司名称"] + [None] * 11 + ["ESG分数"]
    values, scores = [float(i) for i in range(10)], [i + 0.5 for i in range(10)]
    good = [["title"], head, line("指标数值", "600001.SH", "One", values, "*ST one", 71.5), line("指标分值", None, None, scores), [None], line("指标数值", None, "Two", values), line("指标分值", None, None, scores)]
    workbook(tmp_path / "good.xlsx", good)
    workbook(tmp_path / "bad.xlsx", [head, line("指标数值", "1", "", values), line("指标分值", None, None, scores), line("指标数值", "1", "again", values), line("指标分值", None, None, scores), line("指标数值", "2", "alone", values), ["stray"]])
    workbook(tmp_path / "headless.xlsx", [["x"]])
    companies, observations, faults = historical_evaluations(read_workbooks(spark, str(tmp_path)).persist())
    got = {r.company_name: r for r in companies.collect() if "good" in r.file}
    assert (got["One"].stock_code, got["One"].exchange, got["One"].st_flag, got["One"].historical_esg_score) == ("600001.SH", "SSE", True, "71.5")
    assert (got["Two"].stock_code, got["Two"].exchange) == ("#N/A", "UNKNOWN")
    seen = [r for r in observations.collect() if "good" in r.file]
    assert len(seen) == 20 and {(r.raw_value, r.historical_score) for r in seen} == {(str(i), f"{i}.5") for i in range(10)} and {r.score_row - r.value_row for r in seen} == {1}
    names = {(r.file.rpartition("/")[2], r.row, r.fault) for r in faults.collect()}
    assert names == {("bad.xlsx", 2, "name_missing"), ("bad.xlsx", 4, "repeated_company"), ("bad.xlsx", 6, "scores_missing"), ("bad.xlsx", 7, "values_missing"), ("headless.xlsx", None, "no_header")}


def test_what_is_no_workbook(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"PK\x03\x04broken")
    assert [r.fault for r in historical_evaluations(read_workbooks(spark, str(tmp_path)))[2].collect()] == ["not_a_workbook"]
