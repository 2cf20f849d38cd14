"""From extracted pages to units and the corpus table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns
from lexmill.sources.files import HEADING_MARK

# The zone of a page and the share of pages that make a running header.
ZONE, SHARE, LEAST, MIN_PAGES = 5, 0.40, 2, 4


def page_lines(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, page, line_no, line."""
    pages = extracted.select(key, F.posexplode("extracted.pages").alias("p", "rows"))
    return pages.select(key, (F.col("p") + 1).alias("page"), F.posexplode("rows").alias("line_no", "line"))


def drop_running_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without headers, footers and page numbers: lines of a page's first or last five that repeat on enough pages, digits apart."""
    ink = lines.where(F.trim("line") != "")
    w = Window.partitionBy(key, "page")
    zone = ink.withColumn("a", F.row_number().over(w.orderBy("line_no"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("line_no")))).where((F.col("a") <= ZONE) | (F.col("b") <= ZONE))
    zone = zone.withColumn("shape", F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"\d+", "#"), r"\s+", " ")))
    pages = lines.groupBy(key).agg(F.count_distinct("page").alias("n_pages"))
    often = zone.groupBy(key, "shape").agg(F.count_distinct("page").alias("n")).join(pages, key).where((F.col("n_pages") >= MIN_PAGES) & (F.col("n") >= F.greatest(F.lit(LEAST), F.ceil(SHARE * F.col("n_pages")))))
    gone = zone.join(often.select(key, "shape", F.lit(True).alias("_often")), [key, "shape"], "left").where(F.col("_often") | F.col("line").rlike(patterns.PAGE_NUMBER))
    return lines.join(gone.select(key, "page", "line_no"), [key, "page", "line_no"], "left_anti")


def parse_pages(spec: str, n_pages: int) -> list[int]:
    """``12-31, 40`` as sorted page numbers within 1..n_pages; ValueError on anything else."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.replace("–", "-").partition("-")
        if not a.strip().isdigit() or b and not b.strip().isdigit():
            raise ValueError(f"not a page range: {part!r}")
        out |= set(range(int(a), int(b or a) + 1))
    return sorted(p for p in out if 1 <= p <= n_pages)


def toc_pages(outline: list[tuple[int, str, int]], titles: list[str], n_pages: int) -> list[int]:
    """Pages of the first outline entry that holds each title (folded), up to and with the page of the next entry of its level or above."""
    fold = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    out: set[int] = set()
    for title in titles:
        for i, (level, name, page) in enumerate(outline):
            if fold(title) in fold(name):
                end = next((p for le, _, p in outline[i + 1 :] if le <= level), n_pages)
                out |= set(range(page, end + 1))
                break
    return sorted(out)


def runs(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of consecutive pages: doc_id, unit, first_page, last_page (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("page")
    islands = pages.select(key, "page").distinct().withColumn("g", F.col("page") - F.row_number().over(w))
    return islands.groupBy(key, "g").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).withColumn("unit", F.row_number().over(Window.partitionBy(key).orderBy("first_page"))).drop("g")


def units(lines: DataFrame, selected: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """unit_id, pages, headings (30 at most), text, n_words of each run of selected pages; all pages are one unit without a selection."""
    pages = selected if selected is not None else lines.select(key, "page")
    spans = runs(pages, key) if selected is not None else lines.groupBy(key).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.lit(1).alias("unit"))
    rows = lines.join(spans, key).where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    if selected is not None:
        rows = rows.join(selected.select(key, "page").distinct(), [key, "page"], "left_semi")
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: x["line"])
    made = rows.groupBy(key, "unit", "first_page", "last_page").agg(sorted_lines.alias("rows"))
    mark = F.lit(HEADING_MARK)
    plain: Column = F.transform("rows", lambda x: F.when(x.startswith(HEADING_MARK), F.substr(x, F.lit(len(HEADING_MARK) + 1))).otherwise(x))
    heads = F.slice(F.transform(F.filter("rows", lambda x: x.startswith(mark)), lambda x: F.substr(x, F.lit(len(HEADING_MARK) + 1))), 1, 30)
    text = F.array_join(plain, "\n")
    return made.select(key, F.format_string("%s-U%02d", F.col(key).cast("string"), "unit").alias("unit_id"), F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page")).alias("pages"), heads.alias("headings"), text.alias("text"), F.regexp_count(text, F.lit(r"(?U)\w+")).alias("n_words"))


def citation(date: str | None = None) -> Column:
    """``Org. Title (ref). Year, updated X. Retrieved D from URL.`` of a manifest row; the date is its retrieval_date unless given."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ref = F.when(has("reference_number"), F.concat(F.lit(" ("), F.col("reference_number"), F.lit(")"))).otherwise("")
    year = F.when(has("publication_date"), F.left("publication_date", F.lit(4))).otherwise("n.d.")
    updated = F.when(has("last_updated_date"), F.concat(F.lit(", updated "), F.col("last_updated_date"))).otherwise("")
    return F.concat(F.col("organization"), F.lit(". "), F.col("title"), ref, F.lit(". "), year, updated, F.lit(". Retrieved "), F.lit(date) if date else F.col("retrieval_date"), F.lit(" from "), F.col("source_url"), F.lit("."))


def build(manifest: DataFrame, registry: DataFrame, unit_rows: DataFrame, quality: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The corpus (manifest, registry, quality, units in order, text joined by blank lines) and the documents skipped with the reason."""
    own = F.array_sort(F.collect_list(F.struct("unit_id", "pages", "headings", "text", "n_words")))
    grouped = unit_rows.groupBy(key).agg(own.alias("units"), F.sum("n_words").alias("n_words"))
    rows = manifest.join(registry.drop("format"), key, "left").join(quality.select(key, F.col("status").alias("qc_status"), F.col("flags").alias("qc_flags")), key, "left").join(grouped, key, "left")
    reason = F.when(F.col("units").isNull(), "no units").when(F.col("qc_status") == "reject", "QC reject")
    text = F.array_join(F.transform("units", lambda u: u["text"]), "\n\n")
    done = rows.where(reason.isNull()).withColumns({"text": text, "n_units": F.size("units"), "n_chars": F.length(text), "citation": citation()})
    return done, rows.where(reason.isNotNull()).select(key, reason.alias("reason"))
