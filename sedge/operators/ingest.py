"""Parsed documents: section classes, reading order, captions of figures, and TEI sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heading patterns in the order they are tried, and what counts as a figure caption.
HEADINGS = (
    ("experimental", r"\b(experimental|materials\s+and\s+methods|synthesis|sample\s+prep|device\s+fab|fabrication|preparation|procedure)\b"),
    ("results", r"\b(results?|characterization|performance|optical\s+propert|discussion)\b"),
    ("introduction", r"\b(introduction|background|motivation|overview)\b"),
    ("conclusion", r"\b(conclu\w*|summary|outlook|perspective)"),
)
CAPTION = r"^\s*fig(?:ure)?\.?\s*\d+[a-zA-Z]?\s*(?:[\.:\|–—\n]|\s{2,}|$)"
SEARCH, MIN_WIDTH, MIN_HEIGHT, MIN_REGION, LONGER = 150, 200, 200, 50.0, 20
SECTION_ORDER = ("abstract", "introduction", "experimental", "results", "conclusion", "other")


def classify_heading(head: Column) -> Column:
    out = F.when(head.isNull(), "other")
    for name, pattern in HEADINGS:
        out = out.when(head.rlike("(?i)" + pattern), name)
    return out.otherwise("other")


def is_caption(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + CAPTION), F.lit(False))


def caption_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)fig(?:ure)?\.?\s*(\d+)", 1).try_cast("int")


def page_text(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, page_text) of blocks (doc, page, page_width, x0, y0, text): the left column by y, then the right."""
    entry = F.struct((F.col("x0") >= F.col("page_width") / 2).alias("right"), "y0", "x0", F.trim("text").alias("text"))
    pages = blocks.where(F.trim("text") != "").groupBy(doc, "page").agg(F.array_sort(F.collect_list(entry)).alias("b"))  # one page
    return pages.select(doc, "page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("page_text"))


def document_text(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_text"))), lambda x: x["page_text"]), "\n\n").alias("text"))


def captions_below(images: DataFrame, blocks: DataFrame, doc: str = "doc_id", search: int = SEARCH) -> DataFrame:
    """Large images (doc, page, image_no, width, height, y1) with the text below them within reach: the first caption,
    where there is none the first block, else nothing.

    A range join by buckets of the search distance: each image meets the blocks of two buckets, by equality.
    """
    large = images.where((F.col("width") >= MIN_WIDTH) & (F.col("height") >= MIN_HEIGHT))
    big = large.withColumn("_bucket", F.explode(F.array(F.floor(F.col("y1") / search), F.floor(F.col("y1") / search) + 1)))
    text = blocks.select(doc, "page", F.col("y0").alias("caption_y"), F.trim("text").alias("caption"), (~is_caption(F.col("text"))).alias("_other"), F.floor(F.col("y0") / search).alias("_bucket"))
    met = big.join(text, [doc, "page", "_bucket"]).where((F.col("caption_y") > F.col("y1")) & (F.col("caption_y") < F.col("y1") + search))
    keys = [c for c in images.columns]
    best = met.groupBy(*keys).agg(F.min(F.struct("_other", "caption_y", "caption")).alias("c"))
    return large.join(best, keys, "left").select(*keys, F.coalesce("c.caption", F.lit("")).alias("caption"))


def uncovered_captions(blocks: DataFrame, found: DataFrame, doc: str = "doc_id", least: float = MIN_REGION) -> DataFrame:
    """Captions of a page that no image on it has, with the top of the region above them: just below the lowest block
    that ends above, or below the page's edge. Regions under `least` in height are left out."""
    caps = blocks.where(is_caption(F.col("text"))).select(doc, "page", F.col("y0").alias("caption_y"), F.trim("text").alias("caption"))
    caps = caps.join(found.select(doc, "page", "caption").distinct(), [doc, "page", "caption"], "left_anti")
    above = blocks.select(doc, "page", F.col("y1").alias("bottom"))
    bottom = F.max(F.when(F.col("bottom") < F.col("caption_y") - 5, F.col("bottom")))
    tops = caps.join(above, [doc, "page"], "left").groupBy(doc, "page", "caption", "caption_y").agg((F.coalesce(bottom, F.lit(0.0)) + 2).alias("region_top"))
    return tops.where(F.col("caption_y") - F.col("region_top") >= least)


def largest_by_caption(figures: DataFrame, doc: str, caption: str, size: str, order: str) -> DataFrame:
    """The largest figure of each caption, the earliest of equals, numbered by page and caption from 1.

    The largest is an aggregate that combines before the shuffle; only a document's kept figures are ranked.
    """
    rest = [c for c in figures.columns if c not in (doc, caption)]
    # sizes compare before orders: the greatest size, then the least order
    best = F.min_by(F.struct(*rest), F.struct((-F.col(size)).alias("s"), F.col(order).alias("o")))
    kept = figures.groupBy(doc, caption).agg(best.alias("_b")).select(doc, caption, *(F.col("_b")[c].alias(c) for c in rest))
    return kept.select(*figures.columns).withColumn("figure_number", F.row_number().over(Window.partitionBy(doc).orderBy("page", caption)))


def enrich_captions(figures: DataFrame, sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Captions replaced by the last one of the sections with their number, where that is longer by LONGER."""
    best = sections.groupBy(doc, "number").agg(F.max_by("caption", "ord").alias("_new"))
    out = figures.withColumn("number", caption_number(F.col("caption"))).join(best, [doc, "number"], "left")
    return out.withColumn("caption", F.when(F.length("_new") > F.length("caption") + LONGER, F.col("_new")).otherwise(F.col("caption"))).drop("_new", "number")


def full_text(sections: dict[str, Column]) -> Column:
    """Sections in their canonical order, blank ones left out."""
    return F.concat_ws("\n\n", *(F.nullif(F.trim(sections[s]), F.lit("")) for s in SECTION_ORDER if s in sections))


_TEI = "{http://www.tei-c.org/ns/1.0}"
#: What a TEI document holds: metadata, sections in order (with their head), and captions of figures.
TEI = "struct<title:string,doi:string,abstract:string,sections:array<struct<ord:int,head:string,text:string>>,captions:array<string>,error:string>"


def _said(e) -> str:
    """All text of an element with single blanks."""
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def read_tei(xml: str | None) -> dict:
    """The parts of one TEI document. Sections are the divisions directly below the body that have paragraphs, with
    their paragraphs apart; the abstract isn't one of them. Malformed XML gives an error and nothing else."""
    import xml.etree.ElementTree as ET

    none = {"title": None, "doi": None, "abstract": None, "sections": [], "captions": [], "error": None}
    try:
        root = ET.fromstring((xml or "").encode("utf-8"))
    except ET.ParseError as e:
        return none | {"error": str(e)}
    t = _TEI if root.tag.startswith(_TEI) else ""

    def first(path: str):
        return root.find(f".//{t}teiHeader//{path}")

    sections = []
    for division in root.findall(f".//{t}body/{t}div"):
        said = [x for x in map(_said, division.findall(f"{t}p")) if x]
        if said:
            sections.append({"ord": len(sections) + 1, "head": _said(division.find(f"{t}head")) or None, "text": "\n\n".join(said)})
    captions = [c for f in root.iter(f"{t}figure") if (c := f"{_said(f.find(f'{t}head'))} {_said(f.find(f'{t}figDesc'))}".strip())]
    about = {"title": _said(first(f"{t}title[@level='a']")), "doi": _said(first(f"{t}idno[@type='DOI']")), "abstract": _said(first(f"{t}abstract"))}
    return none | {k: v or None for k, v in about.items()} | {"sections": sections, "captions": captions}


def tei(df: DataFrame, xml: str, out: str = "tei") -> DataFrame:
    """Adds the parts of TEI documents (see TEI): each is parsed once, in Arrow batches."""

    @F.pandas_udf(TEI)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([read_tei(x if isinstance(x, str) else None) for x in s], columns=["title", "doi", "abstract", "sections", "captions", "error"])

    return df.withColumn(out, run.asNondeterministic()(F.col(xml)))


def tei_sections(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """(keep..., ord, head, section, text) of the divisions of TEI documents."""
    rows = tei(df, xml, "_tei").select(*keep, F.explode("_tei.sections").alias("_s")).select(*keep, "_s.*")
    return rows.withColumn("section", classify_heading(F.col("head")))


def sections_by_class(sections: DataFrame, *keep: str) -> DataFrame:
    """(keep..., section, text): the sections of a class in their order; those of no class with their heads."""
    labelled = F.when((F.col("section") == "other") & F.col("head").isNotNull(), F.concat(F.lit("["), "head", F.lit("]\n"), "text")).otherwise(F.col("text"))
    lists = sections.groupBy(*keep, "section").agg(F.array_sort(F.collect_list(F.struct("ord", labelled.alias("text")))).alias("x"))  # one document's
    return lists.select(*keep, "section", F.array_join(F.transform("x", lambda y: y["text"]), "\n\n").alias("text"))


def is_tei(status: Column, body: Column) -> Column:
    """Whether a service's answer is a TEI document: full or partial content that starts as one (a page that says the
    service is waking up doesn't)."""
    s = F.trim(body)
    return F.coalesce(status.isin(200, 206) & (s.startswith("<?xml") | F.substring(s, 1, 200).contains("<TEI ")), F.lit(False))


def table_text(headers: Column, rows: Column) -> Column:
    """A table as text: headers, a rule of their width (20 at least), rows; null for a table without rows or cells."""
    head = F.array_join(F.transform(headers, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    empty = ~F.exists(F.concat(F.array(headers), rows), lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    return F.when((F.size(rows) > 0) & ~empty, F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), F.greatest(F.length(head), F.lit(20)))), lines), "\n"))
