"""Review sources and sinks (SRC-1..3, SRC-6..8, SNK-1/2, PRJ-1..4).

Uploaded review files are CSV or XLSX with a required ``Reviews`` column; other
columns pass through. All columns are read as strings.
"""

from __future__ import annotations

import sys

import io
import json
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..functions.lexicons import NA_TOKENS, get_lexicon, lexicon_rows
from ..session import spread

# Functions here run inside Python workers; ship this module's code with the
# task (pickled by value) so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUIRED = "Reviews"


def require_reviews(df: DataFrame, column: str = REQUIRED) -> DataFrame:
    """PRJ-1: plan-time check that the review column exists."""
    if column not in df.columns:
        raise ValueError(f"no column named '{column}' in the review file")
    return df


def normalise_na_columns(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """PRJ-3: pandas NA tokens read as NULL in every string column."""
    return df.select(*[T.normalise_na(F.col(f"`{c}`"), tokens).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def with_review_id(df: DataFrame, key: str = "review_id") -> DataFrame:
    """A unique per-row id without a global shuffle or a single-partition
    window. It depends on the input splits: write the frame (``write_staging``)
    before reading it more than once."""
    return df.withColumn(key, F.monotonically_increasing_id())


def read_reviews_csv(spark: SparkSession, path: str, na_tokens=NA_TOKENS) -> DataFrame:
    """SRC-1: header CSV, quoted newlines and doubled quotes, all strings. A
    file with quoted newlines is one scan task, so its rows are spread over the
    cluster before any text work."""
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
          .option("escape", '"').option("inferSchema", False).csv(path))
    df = spread(require_reviews(df))
    return normalise_na_columns(df, na_tokens) if na_tokens else df


# --- XLSX -------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_R_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
# Number formats of dates and times that need no definition.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _plain(el) -> str:
    """Text of a string item: its own and its runs', not their phonetic readings."""
    out = ""
    for child in el:
        if child.tag == _M + "t":
            out += child.text or ""
        elif child.tag == _M + "r":
            out += "".join(t.text or "" for t in child.findall(_M + "t"))
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), out)


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """For every cell style: whether it shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", _NS)}

    def shows_date(i: str) -> bool:
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(i, ""))
        return int(i) in _DATE_FORMATS or bool(re.search("[dmyhs]", code, re.I)) and "general" not in code.lower()

    return [shows_date(x.get("numFmtId", "0")) for x in root.findall("m:cellXfs/m:xf", _NS)]


def _date_text(value: str, from_1904: bool) -> str:
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    at = start + timedelta(milliseconds=round(float(value) * 86_400_000))
    return at.isoformat(sep=" ", timespec="milliseconds" if at.microsecond else "seconds")


def iter_xlsx_first_sheet(data: bytes):
    """Rows of the first worksheet as strings, one after the other (stdlib only).
    Truth values read True and False, dates as ISO text; a cell without a
    reference follows the one before it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_plain(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        dates = _date_styles(z)
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        info = wb.find("m:workbookPr", _NS)
        from_1904 = info is not None and info.get("date1904") in ("1", "true")
        rid = wb.find("m:sheets/m:sheet", _NS).get(f"{{{_R_NS}}}id")
        target = "worksheets/sheet1.xml"
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                if r.get("Id") == rid:
                    target = r.get("Target").lstrip("/")
                    target = target[3:] if target.startswith("xl/") else target

        def value(c) -> str | None:
            t, v = c.get("t"), c.find(_M + "v")
            if t == "inlineStr":
                inner = c.find(_M + "is")
                return _plain(inner) if inner is not None else None
            if v is None or v.text is None:
                return None
            if t == "s":
                return shared[int(v.text)]
            if t == "b":
                return "True" if v.text == "1" else "False"
            style = int(c.get("s", "0"))
            if t in (None, "n") and style < len(dates) and dates[style]:
                return _date_text(v.text, from_1904)
            return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), v.text) if t == "str" else v.text

        with z.open("xl/" + target) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != _M + "row":
                    continue
                vals: dict[int, str | None] = {}
                at = -1
                for c in row.findall(_M + "c"):
                    at = _col_index(c.get("r")) if c.get("r") else at + 1
                    vals[at] = value(c)
                yield [vals.get(i) for i in range(max(vals) + 1 if vals else 0)]
                row.clear()


def parse_xlsx_first_sheet(data: bytes) -> list[list[str | None]]:
    return list(iter_xlsx_first_sheet(data))


def _written(text: str) -> str:
    """A text as workbooks store it: XML, control characters as _xHHHH_."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def workbook_bytes(rows: list[list]) -> bytes:
    """A workbook with one sheet of inline strings and truth values."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_written(str(v))}</t></is></c>'

    sheet = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{_R_NS}"><sheets><sheet name="Reviews" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def _header(rows: list[list[str | None]]) -> list[str]:
    return [h if h is not None else "" for h in rows[0]] if rows else []


# Rows of a workbook that are handed on together.
XLSX_ROWS = 1000


def read_reviews_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None,
                      na_tokens=NA_TOKENS, required: str = REQUIRED) -> DataFrame:
    """SRC-2: the workbooks of a folder (see :func:`workbook_rows`)."""
    files = spread(spark.read.format("binaryFile").load(path).select("path", "content"))
    return workbook_rows(files, columns, na_tokens, required)


def workbook_rows(files: DataFrame, columns: list[str] | None = None, na_tokens=NA_TOKENS, required: str = REQUIRED) -> DataFrame:
    """SRC-2: many workbooks read in parallel, ``files`` being (path, content);
    the first row of a workbook's first sheet is its header, the others are
    streamed. The output has every column that any workbook has (``columns``
    fixes it instead, and saves a pass over the headers); a workbook without the
    required column is an error. NA tokens are NULL, as in CSV files."""
    files = files.select("path", "content")

    def headers(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "header": [_header([next(iter_xlsx_first_sheet(bytes(c)), [])]) for c in pdf["content"]]})

    if columns is None:
        # Distinct column names over all workbooks, in order of first
        # appearance by position, then name: bounded by the widest layouts.
        names = (files.mapInPandas(headers, "path string, header array<string>")
                 .select(F.posexplode("header").alias("at", "name")).where("name <> ''")
                 .groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect())
        if not names:
            raise ValueError("no workbook with a header")
        columns = [r["name"] for r in names]
    cols = list(columns)
    schema = Ty.StructType([Ty.StructField("source_file", Ty.StringType())] +
                           [Ty.StructField(c, Ty.StringType()) for c in cols])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = iter_xlsx_first_sheet(bytes(content))
                header = _header([next(rows, [])])
                if required not in header:
                    raise ValueError(f"no column named '{required}' in {p}")
                idx = {h: i for i, h in reversed(list(enumerate(header)))}
                held = []
                for r in rows:
                    held.append([p] + [r[idx[c]] if c in idx and idx[c] < len(r) else None for c in cols])
                    if len(held) >= XLSX_ROWS:
                        yield pd.DataFrame(held, columns=["source_file"] + cols)
                        held = []
                yield pd.DataFrame(held, columns=["source_file"] + cols)

    out = require_reviews(files.mapInPandas(run, schema), required)
    if not na_tokens:
        return out
    return out.select("source_file", *[T.normalise_na(F.col(f"`{c}`"), na_tokens).alias(c) for c in cols])


def write_workbooks(rows: DataFrame, path: str, columns: list[str], per_workbook: int = 100, key: str = "review_id") -> None:
    """Workbooks of ``columns`` (texts and truth values) as rows (path, content) of
    a Parquet folder, rows with ``key`` k in workbook k // per_workbook: bounded
    groups, and any store that Spark writes to."""
    def build(pdf):
        import pandas as pd
        name = f"reviews-{pdf['_book'].iloc[0]}.xlsx"
        pdf = pdf.sort_values(key)
        table = [columns] + [[None if v is None else bool(v) if isinstance(v, bool) else v for v in r] for r in zip(*(pdf[c].tolist() for c in columns))]
        return pd.DataFrame({"path": [name], "content": [workbook_bytes(table)]})

    (rows.select(key, *[c for c in columns if c != key], F.floor(F.col(key) / per_workbook).alias("_book"))
     .groupBy("_book").applyInPandas(build, "path string, content binary").write.mode("overwrite").parquet(path))


def read_reviews(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC-3: dispatch on the extension (``.csv`` / ``.xlsx``)."""
    kind = fmt or (path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else "")
    if kind == "csv":
        return read_reviews_csv(spark, path)
    if kind == "xlsx":
        return read_reviews_xlsx(spark, path)
    raise ValueError(f"cannot tell the format of {path!r}: expected .csv or .xlsx")


def reviews_from_list(spark: SparkSession, reviews: list[str | None], batch: str | None = None) -> DataFrame:
    """SRC-8: request batch ``reviews: List[str]``, ``review_id`` = position."""
    return spark.createDataFrame([(i, batch, r) for i, r in enumerate(reviews)],
                                 "review_id BIGINT, batch STRING, reviews STRING")


def stringify(df: DataFrame, column: str = REQUIRED, keep_nulls_as_nan: bool = False) -> DataFrame:
    """PRJ-2 / PRJ-4: cast to string; drop NULLs, or (option) keep them as ``'nan'``."""
    c = F.col(column).cast("string")
    if keep_nulls_as_nan:
        return df.withColumn(column, F.coalesce(c, F.lit("nan")))
    return df.where(F.col(column).isNotNull()).withColumn(column, c)


def lexicon_frame(spark: SparkSession, name: str) -> DataFrame:
    """SRC-7: a lexicon as ``(lexicon, aspect_ord, aspect, kw_ord, keyword)``."""
    return spark.createDataFrame(lexicon_rows(name),
                                 "lexicon STRING, aspect_ord INT, aspect STRING, kw_ord INT, keyword STRING")


def load_lexicon_json(path: str) -> dict[str, list[str]]:
    """SRC-6: a JSON lexicon file (object of arrays); key order is kept."""
    with open(path, encoding="utf-8") as f:
        lex = json.load(f)
    if not isinstance(lex, dict) or not all(isinstance(v, list) for v in lex.values()):
        raise ValueError("lexicon must be an object of arrays")
    return get_lexicon(lex)


def write_staging(df: DataFrame, path: str) -> None:
    """SNK-1: stage a frame (parquet, no index column)."""
    df.write.mode("overwrite").parquet(path)


# Rows of a result file. A file with line ends in its cells is read by one task, so
# its size must not follow the size of what a writing task held.
FILE_ROWS = 2000


def write_results_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """SNK-2: header CSV with doubled-quote escaping, at most FILE_ROWS rows a file.
    Spark's writer trims cells unless told not to."""
    (df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", FILE_ROWS).option("compression", compression).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
