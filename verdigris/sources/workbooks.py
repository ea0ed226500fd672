"""Workbooks as rows of cells: every sheet of every file of a folder, read where the file lies, one file a task."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.universe import exchange_of
from verdigris.sources.readers import HEADER_ALIASES

BATCH = 2000
ROWS = "file string, sheet string, row int, cells array<string>, fault string"
MAIN, RELATED = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference).group(0):
        n = n * 26 + ord(letter) - 64
    return n - 1


def _plain(text: str) -> str:
    """A number as people write it: whole ones without decimals."""
    return re.sub(r"^(-?\d+)\.0+$", r"\1", text.strip())


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """sheet, row, cells of a workbook, row by row; what a sheet says about its own size does not count."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = posixpath.normpath(posixpath.join("xl", targets[sheet.get(f"{RELATED}id")])).replace("xl/xl/", "xl/").lstrip("/")
            with book.open(path) as stream:
                number = 0
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: list[str | None] = []
                    for cell in row.iter(f"{MAIN}c"):
                        at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                        if kind == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if kind == "s" else value.text if kind in ("str", "e") else _plain(value.text)
                    yield sheet.get("name"), number, cells
                    row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells, fault; a file that is no workbook gives one row with its fault. Spark's reader passes over empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "sheet", "row", "cells", "fault"])

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    for sheet, number, cells in sheet_rows(content.as_py()):
                        rows.append((name, sheet, number, cells, None))
                        if len(rows) == BATCH:
                            yield sent(rows)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as error:
                    rows.append((name, None, None, None, f"not_a_workbook: {error}"))
                if rows:
                    yield sent(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def workbook_table(rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """file, row and a map from header to text: the first sheet of each file under its first row, as of a table with a header.

    Headers are known by their aliases whatever blanks, dashes, underscores and brackets they have.
    """
    tidy = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_\-（）()]+", ""))
    first = rows.filter("fault IS NULL").groupBy("file").agg(F.min_by(F.struct("sheet", "cells", "row"), "row").alias("h"))
    known = {re.sub(r"[\s_\-（）()]+", "", k).lower(): v for k, v in (HEADER_ALIASES if aliases is None else aliases).items()}

    def named(cell):
        out = tidy(cell)
        for alias, name in known.items():
            out = F.when(tidy(cell) == alias, name).otherwise(out)
        return out

    names = F.transform("h.cells", named)
    # a file has one header: it is joined to its rows
    body = rows.filter("fault IS NULL").join(first.select("file", "h.sheet", names.alias("names"), F.col("h.row").alias("_first")), ["file", "sheet"]).filter("row > _first")
    cells = F.transform("names", lambda n, i: F.struct(n.alias("key"), F.trim(F.coalesce(F.get("cells", i), F.lit(""))).alias("value")))
    kept = F.filter(cells, lambda c: c["key"] != "")
    return body.select("file", "row", F.map_from_entries(F.filter(kept, lambda c, i: F.array_position(F.transform(kept, lambda x: x["key"]), c["key"]) == i + 1)).alias("fields"))


#: What a historical evaluation's sheet has in its columns.
HISTORICAL = (
    ("Q_E_GHG_INTENSITY", "温室气体排放强度"), ("Q_E_ENERGY_INTENSITY", "综合能源消耗强度"), ("Q_E_NOX_INTENSITY", "NOx"), ("Q_E_SO2_INTENSITY", "SO2"), ("Q_E_WATER_INTENSITY", "新鲜水资源消耗强度"),
    ("Q_E_GENERAL_WASTE_INTENSITY", "一般固废排放强度"), ("H_ENV_SAFETY_INVEST_RATE", "环保/安全生产投入占比"), ("Q_S_RD_RATE", "研发费用占比"), ("Q_S_DIVIDEND_PER_SHARE", "现金分红"), ("Q_G_DEBT_ASSET_RATE", "资产负债率"),
)
VALUES, SCORES = "指标数值", "指标分值"
RANK, CONTACT, CITY, CODE, SHORT, NAME, KIND, FIRST, TOTAL = 0, 3, 4, 5, 6, 7, 8, 9, 19
# End of fixed values.


def historical_evaluations(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies, observations (ten indicators each, unpivoted) and faults of historical evaluation sheets.

    Below the header a company has a row of values and right after it a row of scores. A sheet without a header, a row out of
    its place, a company without a name or twice are faults; of a file with faults nothing should be used.
    """
    sheet = ["file", "sheet"]
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    has = lambda x: F.array_contains(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), x)
    sound = rows.filter("fault IS NULL")
    head = sound.groupBy(*sheet).agg(F.min(F.when(has("公司简称") & has("公司名称") & has("ESG分数"), F.col("row"))).alias("_head"))
    ordered = Window.partitionBy(*sheet).orderBy("row")  # rows of one sheet
    below = sound.join(head, sheet).filter("row > _head").filter(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    lined = below.withColumn("kind", cell(KIND)).withColumns({"_next": F.lead("kind").over(ordered), "_after": F.lead("row").over(ordered), "_last": F.lag("kind").over(ordered), "scores": F.lead("cells").over(ordered)})
    code = F.upper(F.regexp_replace(cell(CODE), " ", ""))
    values = lined.filter(F.col("kind") == VALUES).withColumns({"stock_code": F.when(code == "", "#N/A").otherwise(code), "company_name": cell(NAME)})
    identity = F.when(F.col("stock_code") != "#N/A", F.col("stock_code")).otherwise(F.concat(F.lit("NAME:"), F.col("company_name")))
    paired = values.filter((F.col("_next") == SCORES) & (F.col("_after") == F.col("row") + 1)).withColumn("identity", identity)
    companies = paired.select(
        *sheet, "row", "stock_code", "company_name", cell(SHORT).alias("company_abbr"), cell(RANK).alias("historical_rank"), cell(CONTACT).alias("contact_name"), cell(CITY).alias("company_city"), cell(TOTAL).alias("historical_esg_score"),
        F.coalesce(exchange_of(F.col("stock_code")), F.lit("UNKNOWN")).alias("exchange"), cell(SHORT).rlike(r"(?i)^\*?ST").alias("st_flag"))
    score = lambda i: F.trim(F.coalesce(F.get("scores", F.lit(i)), F.lit("")))
    each = F.array(*[F.struct(F.lit(c).alias("indicator_code"), F.lit(n).alias("source_indicator_name"), cell(FIRST + i).alias("raw_value"), score(FIRST + i).alias("historical_score")) for i, (c, n) in enumerate(HISTORICAL)])
    observations = paired.select(*sheet, "stock_code", "company_name", F.inline(each), F.col("row").alias("value_row"), F.col("_after").alias("score_row"))
    place = F.when(F.col("kind") == VALUES, F.when(~F.coalesce((F.col("_next") == SCORES) & (F.col("_after") == F.col("row") + 1), F.lit(False)), "scores_missing").when(cell(NAME) == "", "name_missing")).when((F.col("kind") != SCORES) | (F.coalesce("_last", F.lit("")) != VALUES), "values_missing")
    faults = lined.select(*sheet, "row", place.alias("fault")).filter("fault IS NOT NULL").unionByName(head.filter("_head IS NULL").select(*sheet, F.lit(None).cast("int").alias("row"), F.lit("no_header").alias("fault")))
    twice = paired.groupBy(*sheet, "identity").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row")).filter("n > 1").select(*sheet, "row", F.lit("repeated_company").alias("fault"))
    broken = rows.filter("fault IS NOT NULL").select(*sheet, "row", F.lit("not_a_workbook").alias("fault"))
    return companies, observations, faults.unionByName(twice).unionByName(broken)
