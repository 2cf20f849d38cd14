"""Raw document files to pages of lines: discovery, registry, and extraction by format.

Extraction never stops a job: a document that can't be read has an ``error`` and no lines.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by extension, and what HTML extraction leaves out.
FORMATS = {"pdf": "pdf", "html": "html", "htm": "html", "docx": "docx", "csv": "csv", "txt": "txt"}
DROPPED_TAGS = frozenset("script style noscript svg iframe form button template link meta input select textarea canvas video audio picture".split())
STRUCTURE_TAGS = frozenset("nav header footer aside".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo search complementary dialog".split())
DROPPED_NAMES = frozenset(
    "cookie cookies consent breadcrumb breadcrumbs skip share sharing social feedback newsletter print subscribe modal vjs brightcove credit".split()
)
BLOCK_TAGS = frozenset("p li dt dd blockquote figcaption pre tr table ul ol div section h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_IDS, MAIN_CLASSES = frozenset("maincontent main-content main content".split()), frozenset("main-content content".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING_MARK = "[[HEADING]] "
SMALL_FILE = 2048


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder whose name begins with a document id and ``__``: doc_id, path, format, length, modificationTime, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return rows.select(F.regexp_extract(name, r"^(D\d{2})__", 1).alias("doc_id"), "path", F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).alias("format"), "length", "modificationTime", "content").where(F.col("format").isNotNull())


def register(files: DataFrame, manifest: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The registry (doc_id, raw_path, format, sha256, size_bytes, file_date) and warnings (doc_id, problem)."""
    rows = files.select("doc_id", F.col("path").alias("raw_path"), "format", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.to_date("modificationTime").cast("string").alias("file_date"))
    own = rows.join(manifest.select("doc_id").distinct(), "doc_id", "left_semi")
    registry = own.groupBy("doc_id").agg(*[F.min_by(c, "raw_path").alias(c) for c in ("raw_path", "format", "sha256", "size_bytes", "file_date")], F.count("*").alias("_n"))
    say = lambda d, what: d.select("doc_id", F.lit(what).alias("problem"))
    warn = say(registry.where("_n > 1"), "several files").unionByName(say(registry.where(F.col("size_bytes") < SMALL_FILE), "small file"))
    warn = warn.unionByName(say(rows.join(manifest.select("doc_id"), "doc_id", "left_anti"), "stray file")).unionByName(say(manifest.join(registry, "doc_id", "left_anti"), "no file"))
    if "format" in manifest.columns:
        both = registry.join(manifest.select("doc_id", F.col("format").alias("_said")), "doc_id")
        warn = warn.unionByName(say(both.where(F.lower("_said") != F.col("format")), "format differs"))
    if previous is not None:
        both = registry.join(previous.select("doc_id", F.col("sha256").alias("_old")), "doc_id")
        warn = warn.unionByName(say(both.where(F.col("_old") != F.col("sha256")), "hash changed"))
    return registry.drop("_n"), warn


class _Html(HTMLParser):
    """Collects text by container: the longest main container wins, else the body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, left out, container
        self.parts: dict[int, list[str]] = {0: []}
        self.title: list[str] = []
        self.out, self.box, self.removed = False, 0, 0
        self.open: list[int] = []

    def _names(self, a: dict) -> set[str]:
        return {x for v in (a.get("id"), a.get("class")) for x in re.split(r"[-_\s]+", (v or "").lower()) if x}

    def _add(self, s: str) -> None:
        if not self.out:
            for box in (0, *self.open):
                self.parts[box].append(s)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "br":
            self._add("\n")
        if tag in VOID:
            return
        off = tag in DROPPED_TAGS
        inside = bool(self.open)
        soft = tag in STRUCTURE_TAGS or (a.get("role") or "").lower() in DROPPED_ROLES or not DROPPED_NAMES.isdisjoint(self._names(a))
        off = off or (soft and tag not in ("html", "body", "main", "article"))
        main = tag in ("main", "article") or (a.get("role") or "").lower() == "main" or a.get("id") in MAIN_IDS or not MAIN_CLASSES.isdisjoint((a.get("class") or "").split())
        self.stack.append((tag, self.out, main and not off))
        if off and not self.out:
            self.removed += 1
        self.out = self.out or off
        if main and not self.out:
            box = len(self.parts)
            self.parts[box] = []
            self.open.append(box)
        del inside
        if tag in BLOCK_TAGS:
            self._add("\n")
        if tag in HEADINGS:
            self._add(HEADING_MARK)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCK_TAGS:
                    self._add("\n")
                if tag in ("td", "th"):
                    self._add("; ")
                for _, was, main in reversed(self.stack[i:]):
                    if main and self.open:
                        self.open.pop()
                    self.out = was
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        elif self.stack and self.stack[-1][0] not in ("head",):
            self._add(re.sub(r"\s+", " ", data))


def html_lines(html: str) -> tuple[str, list[str], dict]:
    """Title, lines of the main content with heading marks, and what was done."""
    p = _Html()
    p.feed(html)
    p.close()
    tidy = lambda parts: [x for x in (re.sub(r"[;\s]+$", "", re.sub(r"[ \t]+", " ", line)).strip() for line in "".join(parts).split("\n")) if x and x != HEADING_MARK.strip()]
    boxes = {b: tidy(x) for b, x in p.parts.items()}
    best = max((b for b in boxes if b and boxes[b]), key=lambda b: (sum(map(len, boxes[b])), -b), default=0)
    return "".join(p.title).strip(), boxes[best], {"container": "main" if best else "body", "removed": p.removed}


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs in body order, headings marked, table rows joined and without repeats in a row."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body:
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            if t := text(e):
                out.append((HEADING_MARK if style is not None and (style.get(f"{w}val") or "").lower().startswith("heading") else "") + t)
        elif e.tag == f"{w}tbl":
            for row in e.iter(f"{w}tr"):
                cells = [text(c) for c in row.iter(f"{w}tc")]
                if cells := [c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])]:
                    out.append("; ".join(cells))
    return out


def csv_lines(text: str) -> list[str]:
    """Each row as ``name: value; name: value.`` without empty cells; the dialect is sniffed from the beginning."""
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    out = []
    for row in csv.DictReader(io.StringIO(text), dialect=dialect):
        if cells := [f"{k}: {v.strip()}" for k, v in row.items() if k and isinstance(v, str) and v.strip()]:
            out.append("; ".join(cells) + ".")
    return out


def pdf_lines(content: bytes) -> list[list[str]]:
    """Lines of each page; needs an optional library."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text().split("\n") for page in doc]


EXTRACTED = "struct<title:string,pages:array<array<string>>,info:string,error:string>"


def extract_one(fmt: str, content: bytes) -> dict:
    try:
        title, info = None, ""
        if fmt == "html":
            title, lines, done = html_lines(content.decode("utf-8", "replace"))
            pages, info = [lines], f"container={done['container']}; removed={done['removed']}"
        elif fmt == "docx":
            pages = [docx_lines(content)]
        elif fmt == "csv":
            pages = [csv_lines(content.decode("utf-8-sig", "replace"))]
        elif fmt == "txt":
            pages = [content.decode("utf-8", "replace").split("\n")]
        elif fmt == "pdf":
            pages = pdf_lines(content)
            empty = [i + 1 for i, p in enumerate(pages) if len("".join(p).strip()) < 20]
            info = f"pages={len(pages)}; empty={empty}"
        else:
            raise ValueError(f"unknown format {fmt!r}")
        return {"title": title, "pages": pages, "info": info, "error": None}
    except Exception as e:  # one document's failure is its result
        return {"title": None, "pages": [], "info": None, "error": f"{type(e).__name__}: {e}"}


def extract(files: DataFrame, fmt: str = "format", content: str = "content") -> DataFrame:
    """Adds ``extracted``: title, pages of lines, info, error."""

    @F.pandas_udf(EXTRACTED)
    def run(f: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_one(a, bytes(b)) for a, b in zip(f, c, strict=True)], columns=["title", "pages", "info", "error"])

    return files.withColumn("extracted", run(fmt, content)).drop(content)


def manifest(spark: SparkSession, path: str, lists: tuple[str, ...] = ("topics", "risk_tiers")) -> DataFrame:
    """Active rows of a manifest CSV; list columns are split at ``;``, trimmed and without empties."""
    rows = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", emptyValue="").na.fill("")
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    split = {c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "") for c in lists if c in rows.columns}
    return rows.withColumns(split).where(F.col("status") == "active") if "status" in rows.columns else rows.withColumns(split)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus JSON file (an object with ``documents``)."""
    return spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def result_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result CSV; where it is missing, one row with a message."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, header=True, schema=schema, emptyValue="").na.fill("")
    except AnalysisException:
        return spark.createDataFrame([(f"not there: {path}",)], "message string")
