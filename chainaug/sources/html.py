"""S3: tables held in HTML (generation logs are written as HTML tables).

Rendering groups rows into bounded documents; extraction parses the first table of every
document with JVM-side regular expressions: table -> header cells -> body rows -> cells,
entity unescape (&amp; last) and whitespace normalisation as an HTML table reader does,
empty cells as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_running_start

_WS = "[ \\t\\n\\r\\f\\x0B]+"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def clean_cell(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, f"^{_WS}|{_WS}$", ""), _WS, " ")
    t = unescape(t)
    return F.when(t != "", t)


def render_tables(df: DataFrame, doc_keys: list, order_col: str, cols: list) -> DataFrame:
    """One HTML document per ``doc_keys`` group (callers bound the group size)."""
    head = "".join(f"<th>{c}</th>" for c in cols)
    cells = F.concat(*[F.concat(F.lit("<td>"), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in cols])
    rows = df.select(*doc_keys, F.col(order_col).alias("_o"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>\n")).alias("_tr"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_tr"))), lambda x: x["_tr"]), "")
    return rows.groupBy(*doc_keys).agg(
        F.concat(F.lit('<table border="1" class="dataframe">\n<thead><tr>' + head + "</tr></thead>\n<tbody>\n"),
                 body, F.lit("</tbody>\n</table>\n")).alias("html"))


def bounded_documents(df: DataFrame, keys: list, order_col: str, cols: list, most_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with ``doc``, the document that a row belongs to: rows of one ``keys`` group that follow each other, begun within
    the same ``most_bytes`` of text (so a document is at most that and one row long).  The running sum moves keys and sizes only."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 9 for c in cols), F.lit(10)).cast("long")
    starts = with_running_start(df.select(*keys, order_col, size.alias("_bytes")), [*keys, order_col], "_bytes", "_start")
    return df.join(starts.select(*keys, order_col, F.floor(F.col("_start") / most_bytes).cast("long").alias("doc")), [*keys, order_col])


def extract_first_table(docs: DataFrame, html_col: str, keep: list) -> DataFrame:
    """Rows of the first table of each document: ``keep`` columns + row_no + header + raw cells
    (use ``cell`` to pick and clean a column; cleaning outside a lambda keeps it in codegen).

    The first row is the header, with or without thead / tbody; ``th`` and ``td`` cells of a row count
    alike, so a table written with its row index (an unnamed first column) keeps its columns in place."""
    table = F.regexp_extract(F.col(html_col), "(?s)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit("(?s)<tr(?:\\s[^>]*)?>(.*?)</tr>"), 1)
    cells = lambda c: F.regexp_extract_all(c, F.lit("(?s)<t[hd](?:\\s[^>]*)?>(.*?)</t[hd]>"), 1)
    t = docs.select(*keep, rows.alias("_rows")).where(F.size("_rows") > 0)
    t = t.select(*keep, cells(F.element_at("_rows", 1)).alias("header"),
                 F.posexplode(F.slice("_rows", 2, F.size("_rows"))).alias("row_no", "_tr"))
    return t.select(*keep, "row_no", "header", cells(F.col("_tr")).alias("cells"))


def cell(name: str) -> Column:
    """The cleaned cell under header ``name`` of an extracted row (NULL when absent or empty)."""
    names = F.transform("header", lambda h: F.coalesce(clean_cell(h), F.lit("")))
    place = F.nullif(F.array_position(names, name), F.lit(0)).cast("int")
    return clean_cell(F.try_element_at("cells", place))


def read_html_files(spark, path: str, cols: list, patterns: dict | None = None) -> DataFrame:
    """S3 over files: the columns ``cols`` of the first table of every file, with the file's ``path`` and
    the run keys that ``patterns`` (name -> regular expression with one group) find in it."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("path"))
    keys = {k: F.regexp_extract("path", rx, 1) for k, rx in (patterns or {}).items()}
    rows = extract_first_table(docs.withColumns(keys) if keys else docs, "html", ["path", *keys])
    return rows.select("path", *keys, "row_no", *[cell(c).alias(c) for c in cols])
