"""Queries that go through files: tables are written as workbooks, documents and archives, and read back."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import ExportPlan
from ..ship import scratch
from ..sources import archive, docx, docx_writer, envelope, xlsx, xlsx_writer
from ..streaming import stream_audit, stream_cells
from .queries import _t, query

_ITEM = "l_returnflag STRING, l_linestatus STRING, quantity DOUBLE, price DOUBLE, shipped TIMESTAMP_NTZ, l_linenumber INT"


def _lineitem_workbooks(s, d) -> str:
    """lineitem as workbooks of some ten thousand rows, one for each task."""
    xlsx.register(s)
    folder = scratch(s, "lineitem")
    plan = ExportPlan().column("l_quantity", header="quantity").column("l_extendedprice", header="price").column("l_shipdate", header="shipped").ignore("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    xlsx_writer.balanced(plan.project(_t(s, d, "lineitem"))).write.format("xlsx").mode("append").save(folder)
    return folder


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, min(l_shipdate) AS first_shipped, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1, 2")
def xlsx_export_and_aggregate(s, d) -> DataFrame:
    back = xlsx.read_typed(s, _lineitem_workbooks(s, d), _ITEM)
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("price"), 2).alias("price"), F.min("shipped").alias("first_shipped"), F.sum("l_linenumber").alias("lines"))


@query("SELECT r AS row, c AS col, k AS kind, t AS text, n AS number FROM (SELECT n_nationkey + 2 AS r, unnest([1, 2, 3]) AS c, unnest(['number', 'string', 'number']) AS k, unnest([NULL, n_name, NULL]) AS t, unnest([n_nationkey::DOUBLE, NULL, n_regionkey::DOUBLE]) AS n FROM nation) UNION ALL SELECT 1, unnest([1, 2, 3]), 'string', unnest(['n_nationkey', 'n_name', 'n_regionkey']), NULL")
def xlsx_cells(s, d) -> DataFrame:
    xlsx.register(s)
    path = os.path.join(scratch(s, "nation"), "nation.xlsx")
    xlsx_writer.write_workbook(path, {"Nations": _t(s, d, "nation").orderBy("n_nationkey")})
    return s.read.format("xlsx").option("sheet", "nations").load(path).select("row", "col", "kind", "text", "number")


@query("SELECT 1 AS sheet_index, 'Nations' AS name UNION ALL SELECT 2, 'Regions'")
def xlsx_sheets(s, d) -> DataFrame:
    xlsx.register(s)
    path = os.path.join(scratch(s, "two"), "two.xlsx")
    xlsx_writer.write_workbook(path, {"Nations": _t(s, d, "nation"), "Regions": _t(s, d, "region")})
    return s.read.format("xlsx").option("mode", "sheets").load(path).select("sheet_index", "name")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def xlsx_encrypted(s, d) -> DataFrame:
    path = os.path.join(scratch(s, "secret"), "secret.xlsx")
    xlsx_writer.write_workbook(path, {"Nations": _t(s, d, "nation")}, options=xlsx_writer.Options(password="correct horse"))
    return xlsx.read_sheets(s, path, password="correct horse")["Nations"]


@query("SELECT n_nationkey + 1 AS row, n_regionkey + 1 AS col, 'string' AS kind, n_name AS text FROM nation")
def xlsx_sparse_model(s, d) -> DataFrame:
    path = os.path.join(scratch(s, "sparse"), "sparse.xlsx")
    cells = _t(s, d, "nation").select(F.lit("S").alias("sheet"), (F.col("n_nationkey") + 1).alias("row"), (F.col("n_regionkey") + 1).alias("col"), F.col("n_name").alias("value"), F.lit(None).cast("string").alias("formula"))
    xlsx_writer.write_cells(path, cells, defined_names={"TaxRate": "0.18"})
    xlsx.register(s)
    return s.read.format("xlsx").load(path).select("row", "col", "kind", "text")


@query("SELECT n_nationkey + 1 AS row, n_regionkey + 1 AS col, 'string' AS kind, n_name AS text FROM nation")
def xlsx_encrypted_cells(s, d) -> DataFrame:
    path = os.path.join(scratch(s, "sparse"), "secret.xlsx")
    cells = _t(s, d, "nation").select(F.lit("S").alias("sheet"), (F.col("n_nationkey") + 1).alias("row"), (F.col("n_regionkey") + 1).alias("col"), F.col("n_name").alias("value"), F.lit(None).cast("string").alias("formula"))
    xlsx_writer.write_cells(path, cells, options=xlsx_writer.Options(password="correct horse"))
    xlsx.register(s)
    return s.read.format("xlsx").option("password", "correct horse").load(path).select("row", "col", "kind", "text")


@query("SELECT n_nationkey + 1 AS row, 'blank' AS kind, 'B' || (n_nationkey + 1) || '*' || n_regionkey AS formula FROM nation")
def xlsx_formulas(s, d) -> DataFrame:
    path = os.path.join(scratch(s, "formulas"), "formulas.xlsx")
    n = F.col("n_nationkey") + 1
    cells = _t(s, d, "nation").select(F.lit("S").alias("sheet"), n.alias("row"), F.lit(1).alias("col"), F.lit(None).cast("string").alias("value"), F.concat(F.lit("B"), n, F.lit("*"), "n_regionkey").alias("formula"))
    xlsx_writer.write_cells(path, cells)
    xlsx.register(s)
    return s.read.format("xlsx").load(path).select("row", "kind", "formula")


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def xlsx_rolled_over(s, d) -> DataFrame:
    """Each task's rows in workbooks of a thousand."""
    xlsx.register(s)
    folder = scratch(s, "orders")
    rows = _t(s, d, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("price"))
    xlsx_writer.balanced(rows).write.format("xlsx").option("maxRowsPerFile", 1000).mode("append").save(folder)
    return xlsx.read_typed(s, folder, "o_orderkey BIGINT, o_orderstatus STRING, price DOUBLE")


@query("SELECT r AS row, c AS col, t AS text FROM (SELECT n_nationkey + 2 AS r, unnest([1, 2]) AS c, unnest([n_name, 'x']) AS t FROM nation) UNION ALL SELECT 1, unnest([1, 2]), unnest(['n_name', 'k'])")
def xlsx_stream(s, d) -> DataFrame:
    folder, out = scratch(s, "incoming"), scratch(s, "cells")
    xlsx_writer.write_workbook(os.path.join(folder, "a.xlsx"), {"S": _t(s, d, "nation").orderBy("n_nationkey").select("n_name", F.lit("x").alias("k"))})
    stream = stream_cells(s, folder)
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{out}/data").select("row", "col", "text")


def _conversation_documents(s, d) -> str:
    """A document for each of the first hundred conversations, its turns as paragraphs, then as a table of role and text."""
    folder = scratch(s, "documents")
    rows = _t(s, d, "conversations").where("conv_id < 100").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def write(group) -> None:
        for r in group:
            doc = docx_writer.Document()
            doc.header("confidential")
            for t in r.turns:
                doc.add_paragraph(t.text)
            table = doc.add_table(2)
            for t in r.turns:
                table.add_row(t.role, t.text)
            doc.save(os.path.join(folder, f"{r.conv_id}.docx"))

    rows.foreachPartition(write)
    docx.register(s)
    return folder


def _id() -> F.Column:
    return F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, text FROM conversations WHERE conv_id < 100")
def docx_paragraphs(s, d) -> DataFrame:
    x = s.read.format("docx").load(_conversation_documents(s, d))
    return x.where("host = 'body'").select(_id().alias("conv_id"), "ord", "text")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS row, unnest([0, 1]) AS col, unnest([role, text]) AS value FROM conversations WHERE conv_id < 100")
def docx_tables(s, d) -> DataFrame:
    from ..operators.cells import explode_grid

    x = s.read.format("docx").option("mode", "tables").load(_conversation_documents(s, d))
    return explode_grid(x.select(_id().alias("conv_id"), "rows"), "rows", "conv_id")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) || string_agg(role || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || 'confidential' AS text FROM conversations WHERE conv_id < 100 GROUP BY 1")
def docx_extract_text(s, d) -> DataFrame:
    files = s.read.format("binaryFile").load(_conversation_documents(s, d))
    return docx.text_of_files(files).select(_id().alias("conv_id"), "text")


@query("SELECT n_nationkey, 'Dear ' || n_name || ', your key is ' || n_nationkey || '.' AS text FROM nation")
def docx_mail_merge(s, d) -> DataFrame:
    doc = docx_writer.Document()
    doc.add_paragraph("Dear {{n_").text("name}}, your key is {{n_nationkey}}.")
    merged = docx_writer.fill_each(_t(s, d, "nation").select("n_nationkey", "n_name"), doc.to_bytes())
    files = merged.select(F.col("n_nationkey").cast("string").alias("path"), F.col("document").alias("content"))
    return docx.text_of_files(files).select(F.col("path").cast("int").alias("n_nationkey"), "text")


@query("SELECT n_name || '.txt' AS name, octet_length(encode(repeat(n_name, 100)))::BIGINT AS size, false AS is_dir FROM nation")
def zip_listing(s, d) -> DataFrame:
    path = os.path.join(scratch(s, "zip"), "nations.zip")
    with archive.ArchiveWriter(path) as w:
        for r in _t(s, d, "nation").orderBy("n_nationkey").toLocalIterator():
            w.add_text(f"{r.n_name}.txt", r.n_name * 100)
    return archive.list_entries(s, path).select("name", "size", "is_dir")


@query("SELECT c_custkey, (c_custkey % 3 + 1)::INT AS copies, 'first:' || (c_custkey % 5 + 1) AS pages, c_name AS document FROM customer")
def spool_envelopes(s, d) -> DataFrame:
    c = _t(s, d, "customer")
    settings = F.struct((F.col("c_custkey") % 3 + 1).cast("int").alias("copies"), F.concat(F.lit("first:"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("pages"))
    packed = c.select("c_custkey", envelope.pack_column(settings, F.encode("c_name", "UTF-8")).alias("e"))
    return packed.select("c_custkey", envelope.unpack_column("e").alias("u")).select("c_custkey", "u.settings.copies", "u.settings.pages", F.decode("u.document", "UTF-8").alias("document"))


@query("SELECT event_id::VARCHAR || chr(9) || event_type || repeat(chr(9), 10) AS value FROM events")
def audit_stream(s, d) -> DataFrame:
    out = scratch(s, "audit")
    events = s.readStream.schema(_t(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream_audit(events.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("title")), f"{out}/lines", f"{out}/state").awaitTermination()
    return s.read.text(f"{out}/lines")


@query("SELECT 0 AS ord, 'image1.png' AS name, 'image/png' AS content_type, 36.0 AS width_pt, 18.0 AS height_pt, 'logo' AS alt, 'inline' AS placement, 'Here: ' AS anchor_text")
def docx_images(s, d) -> DataFrame:
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000020000000108020000007b40e8dd0000000c4944415408d763f8cfc0000003010100") + b"IEND"
    doc = docx_writer.Document()
    doc.add_paragraph("Here: ").image(docx_writer.Picture(png, 36, 18, alt="logo"))
    path = os.path.join(scratch(s, "image"), "image.docx")
    doc.save(path)
    docx.register(s)
    return s.read.format("docx").option("mode", "images").load(path).select("ord", "name", "content_type", "width_pt", "height_pt", "alt", "placement", "anchor_text")


def stress_rows(n: int = 100_000):
    """The rows of the write benchmark."""
    for i in range(1, n + 1):
        yield i, f"Name {i}", (i * 7919) % 100 / 100, dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 2000), i % 2 == 0, f"Category {i % 5}"
