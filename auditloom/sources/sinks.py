"""What an audit hands out: findings as CSV, status and payload as JSON, a workbook of sheets; row tables derived from pages."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import dom_signals as ds
from auditloom.functions import text, urls

#: Labels of accessibility blockers in the payload, in order (fixed values).
BLOCKERS = ("Missing H1 heading", "Missing alt text", "Missing lang tag", "No ARIA landmark regions")
#: The CSV's header (fixed format).
CSV_HEADER = ("Type", "Title", "Severity", "Effort Bucket", "Personas", "Affected Pages", "Description", "Detection Method")


def csv_rows(findings: DataFrame) -> DataFrame:
    """(ord, line) with fields quoted where needed and personas joined by a bar."""
    fields = ["finding_type", "title", "severity", "effort_bucket", F.array_join("personas", "|"), "affected_page_count", "description", "detection_method"]
    return findings.select("ord", F.concat_ws(",", *(text.csv_field(F.col(x) if isinstance(x, str) else x) for x in fields)).alias("line"))


def write_csv(findings: DataFrame, path: str) -> None:
    """One file: a header and a line for each finding; findings are few."""
    lines = [",".join(CSV_HEADER), *(r["line"] for r in csv_rows(findings).orderBy("ord").toLocalIterator())]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def status_json(audits: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """A document for each audit: its fields and the numbers of pages and findings."""
    p, f = pages.groupBy("audit_id").agg(F.count("*").alias("page_count")), findings.groupBy("audit_id").agg(F.count("*").alias("finding_count"))
    met = audits.join(p, "audit_id", "left").join(f, "audit_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select("audit_id", F.to_json(F.struct(*audits.columns, zero("page_count"), zero("finding_count"))).alias("json"))


def form_points(pages: DataFrame) -> DataFrame:
    """Forms with a known purpose: page_ord, url, purpose, field_count."""
    each = pages.select("page_ord", "url", F.explode("dom.forms").alias("f")).where("f.purpose <> 'other'")
    return each.select("page_ord", "url", F.col("f.purpose").alias("purpose"), F.size("f.types").alias("field_count"))


def schema_coverage(pages: DataFrame) -> DataFrame:
    from auditloom.functions.numbers import percent

    n = pages.agg(F.count_if(F.size(ds.schema_types(F.col("dom"))) > 0).alias("typed"), F.count("*").alias("pages"))
    return n.select(percent(F.col("typed"), F.col("pages")).alias("schema_coverage_percent"))


def accessibility_blockers(findings: DataFrame, missing_alt: int) -> DataFrame:
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    axe = F.col("finding_type") == "accessibility_violation"
    title = F.lower("title")
    flags = findings.agg(
        has((F.col("finding_type") == "missing_h1") & (F.col("affected_page_count") > 0)).alias("h1"),
        has(axe & title.contains("alt")).alias("alt"),
        has(F.col("finding_type") == "missing_lang_attribute").alias("lang"),
        has(axe & title.contains("landmark")).alias("landmark"),
    )
    shown = (F.col("h1"), F.col("alt") | F.lit(missing_alt > 0), F.col("lang"), F.col("landmark"))
    labels = F.array(*(F.when(hit, label) for hit, label in zip(shown, BLOCKERS, strict=True)))
    return flags.select(F.filter(labels, lambda x: x.isNotNull()).alias("blockers"))


def payload_json(audit: dict, pages: DataFrame, findings: DataFrame, card: DataFrame, missing_alt: int, backlog: DataFrame) -> DataFrame:
    """The audit's document: metadata, scores, and what each persona asks for, in one row."""
    thin = pages.where("word_count > 0 AND word_count < 150").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "url"))), lambda x: x["url"]).alias("thin_content_urls"))
    clusters = findings.where(F.col("finding_type").isin("near_duplicate_content", "duplicate_title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "affected_urls_sample"))), lambda x: x["affected_urls_sample"]).alias("duplicate_clusters"))
    forms = form_points(pages).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "url", "purpose", "field_count"))), lambda x: F.struct(x["url"].alias("url"), x["purpose"].alias("purpose"), x["field_count"].alias("fieldCount"))).alias("form_conversion_points"))
    items = backlog.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "title", "impact", "effort", "quadrant", "category"))), lambda x: F.struct(*(x[k].alias(k) for k in ("title", "impact", "effort", "quadrant", "category")))).alias("prioritized_backlog_items")
    )
    counted = lambda t: F.coalesce(F.max(F.when(F.col("finding_type") == t, F.col("affected_page_count"))), F.lit(0))
    found = findings.agg(counted("orphan_page").alias("orphan_pages_count"), (counted("missing_title") + counted("missing_meta_description")).alias("missing_metadata_count"))
    site = pages.agg(F.count("*").alias("pages_scanned"), F.greatest(F.lit(0), F.max("depth")).alias("max_click_depth"), F.count_if(F.col("status_code") >= 400).alias("broken_routes_count"))
    row = site
    for part in (found, thin, clusters, forms, items, schema_coverage(pages), accessibility_blockers(findings, missing_alt), card.select("ux_maturity", "ia_health", "content_quality", "accessibility", "seo")):
        row = row.crossJoin(part)
    s = F.struct
    document = s(
        s(F.lit(audit["start_url"]).alias("site_url"), F.lit(audit["crawl_date"]).alias("crawl_date"), "pages_scanned", F.lit(audit.get("rendering_engine", "static")).alias("rendering_engine")).alias("project_metadata"),
        s(F.col("ux_maturity").alias("overall_ux_maturity"), "ia_health", "content_quality", F.col("accessibility").alias("accessibility_wcag"), F.col("seo").alias("seo_findability")).alias("scores"),
        s(
            s("orphan_pages_count", "max_click_depth", F.col("blockers").alias("accessibility_blockers")).alias("ux_lead"),
            s("thin_content_urls", "duplicate_clusters", "missing_metadata_count", "schema_coverage_percent").alias("content_strategist"),
            s("broken_routes_count", "form_conversion_points", "prioritized_backlog_items").alias("business_analyst"),
        ).alias("persona_findings"),
    )
    return row.select(F.to_json(document).alias("json"))


def link_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, source_url, target_url, is_internal) from parsed pages, and the columns of the page to keep."""
    each = pages.select("page_id", F.col("url").alias("source_url"), *keep, F.explode(ds.links(F.col("dom"), F.col("url"))).alias("l"))
    return each.select("page_id", "source_url", F.col("l.url").alias("target_url"), "l.is_internal", *keep)


def asset_rows(pages: DataFrame) -> DataFrame:
    """(page_id, asset_type, url, domain) of images, videos and linked documents of parsed pages."""
    d, url = F.col("dom"), F.col("url")
    images = F.transform(F.filter(d["images"], lambda i: i["src"].isNotNull()), lambda i: F.struct(F.lit("image").alias("asset_type"), urls.resolve(url, i["src"]).alias("url")))
    videos = F.transform(d["videos"], lambda v: F.struct(F.lit("video").alias("asset_type"), urls.resolve(url, v).alias("url")))
    documents = F.transform(ds.documents(d, url), lambda a: F.struct(F.lit("document").alias("asset_type"), a.alias("url")))
    each = pages.select("page_id", F.explode(F.concat(images, videos, documents)).alias("a")).select("page_id", "a.asset_type", "a.url")
    return each.where("url IS NOT NULL").withColumn("domain", F.nullif(urls.host(F.col("url")), F.lit("")))


def interaction_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("dom.interactions").alias("interaction_type"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_audit(df: DataFrame, path: str) -> None:
    """Write findings partitioned by audit; a second run replaces the audit's rows instead of adding to them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(path)


#: Rows that a sheet may have (a limit of the format), and rows that a task packs at once.
SHEET_ROWS, PACKED_ROWS = 1_048_576, 4_096


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v}</v></c>"
    if isinstance(v, (list, tuple)):
        v = "\n".join(map(str, v))
    clean = "".join(c for c in str(v) if c >= " " or c in "\t\n")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean[:32767])}</t></is></c>'


def _row(cells) -> str:
    return f"<row>{''.join(map(_cell, cells))}</row>"


def sheet_chunks(df: DataFrame) -> DataFrame:
    """A sheet's rows as markup, (rows, packed), made by the tasks that hold them; chunks are in the order of df."""
    plain = df.select(*(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.TimestampType, T.DateType, T.DecimalType)) else F.col(f"`{f.name}`") for f in df.schema.fields))
    # numbered names, for a sheet may have a column twice
    plain = plain.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                made = "".join(_row(r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([zlib.compress(made.encode("utf-8", "replace"), 1)])], names=["rows", "packed"])

    return plain.mapInArrow(run, "rows long, packed binary")


def write_xlsx(sheets: dict[str, DataFrame], path: str, most: int = SHEET_ROWS) -> None:
    """A workbook of sheets of any size, at a path of the driver's.

    Tasks turn rows to markup; the driver appends their packed chunks, one at a time, and looks at no row. A sheet with more rows than the
    format allows goes on in further sheets of its name. The file appears whole or not at all.
    """
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names: list[str] = []
    fd, made = tempfile.mkstemp(prefix=".workbook-", dir=os.path.dirname(os.path.abspath(path)))
    os.close(fd)

    @contextlib.contextmanager
    def sheet(z: zipfile.ZipFile, name: str, columns: list[str]):
        names.append(name)
        with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
            f.write(f"{head}<worksheet {main}><sheetData>{_row(columns)}".encode())
            yield f
            f.write(b"</sheetData></worksheet>")

    def pieces(df: DataFrame) -> Iterator[tuple[int, bytes]]:
        """Chunks, cut so that a sheet can end at any row."""
        for r in sheet_chunks(df).toLocalIterator():
            text = zlib.decompress(r["packed"])
            if r["rows"] <= most - 1:
                yield r["rows"], text
            else:
                yield from ((1, row + b"</row>") for row in text.split(b"</row>")[:-1])

    try:
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for name, df in sheets.items():
                waiting, part, left = pieces(df), 0, None
                while part == 0 or left is not None:
                    part += 1
                    tail = "" if part == 1 else f" ({part})"
                    with sheet(z, name[: 31 - len(tail)] + tail, df.columns) as f:
                        free = most - 1
                        for n, text in [left] if left else []:
                            f.write(text)
                            free -= n
                        left = None
                        for n, text in waiting:
                            if n > free:
                                left = (n, text)
                                break
                            f.write(text)
                            free -= n
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
            rels = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        os.replace(made, path)
    except BaseException:
        os.unlink(made)
        raise
