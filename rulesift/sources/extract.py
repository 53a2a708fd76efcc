"""From source texts to units: pages, articles, markup paragraphs, lines, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.functions.text import cumulative, normalize_corpus, trim, utf16_length

# Anchors, headings and the current addendum of statute texts; circled numbers.
FIRST_ARTICLE, LAST_ARTICLE = "제1조(목적)", "제22조(재검토기한)"
ARTICLE_HEAD = r"제\d+조(?:의\d+)?(?:[ \t]*\([^\r\n)]*\)|[ \t]*<[ \t]*삭[ \t]*제[ \t]*>)"
ADDENDUM_HEAD = r"[ \t]*부[ \t]*칙[ \t]*<[ \t]*([^>\r\n]+?)[ \t]*>[ \t]*(?=\r?$)"
CURRENT_ADDENDUM = "제555호, 2026. 2. 12."
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳㉑"


def segments(rows: DataFrame, separator: str, column: str = "text") -> DataFrame:
    """Other columns, segment (from 1), start, end (code points), body: the pieces of a text between separators; each ends where the next's separator begins."""
    rest = [c for c in rows.columns if c != column]
    split = F.split(F.col(column), f"\\Q{separator}\\E", -1)
    starts = cumulative(F.transform(split, lambda x: F.length(x) + len(separator)))
    placed = F.zip_with(starts, split, lambda at, x: F.struct(at.alias("start"), x.alias("body")))
    out = rows.select(*rest, F.posexplode(placed).alias("k", "piece"))
    return out.select(*rest, (F.col("k") + 1).alias("segment"), F.col("piece.start").alias("start"), (F.col("piece.start") + F.length("piece.body")).alias("end"), F.col("piece.body").alias("body"))


def markup_units(rows: DataFrame, column: str, tag: str) -> DataFrame:
    """Other columns, unitIndex, body: text of each element, trimmed; numbered before the empty ones go."""
    rest = [c for c in rows.columns if c != column]
    inner = F.regexp_extract_all(F.col(column), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    units = rows.select(*rest, F.posexplode(inner).alias("k", "raw"))
    return units.select(*rest, (F.col("k") + 1).alias("unitIndex"), trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("body")).where("body <> ''")


def remove_doctype(xml: str) -> str:
    """Without the document type declaration, quotes and inner brackets respected."""
    start = xml.upper().find("<!DOCTYPE")
    if start < 0:
        return xml
    depth, quote = 0, ""
    for i in range(start, len(xml)):
        c = xml[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        elif c == ">" and depth <= 0:
            return xml[:start] + xml[i + 1 :]
    raise ValueError("document type isn't closed")


def hwpml_units(xml: str) -> list[tuple[int, str]]:
    """(number, text) of each paragraph with text: the CHAR texts of each P, in order."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(remove_doctype(xml).replace("&nbsp;", " "))
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for i, p in enumerate((e for e in root.iter() if local(e) == "P"), 1):
        text = "".join("".join(c.itertext()) for c in p.iter() if local(c) == "CHAR").strip().strip("﻿").strip()
        if text:
            out.append((i, text))
    return out


def _flatten(element: dict) -> list[str]:
    """Texts of an element tree: paragraphs, tables (cells by tab, rows by line), text boxes; tables may nest."""
    kind, data = element.get("type"), element.get("data") or element
    if kind == "table":
        rows = ["\t".join(_cell(c) for c in r.get("cells") or []) for r in data.get("rows") or []]
        return ["\n".join(rows)]
    if kind in ("textbox", "textBox"):
        return [t for p in data.get("paragraphs") or [] for t in [_paragraph(p)] if t]
    text = _paragraph(data)
    return [text] if text else []


def _paragraph(p: dict) -> str:
    return "".join(str(r.get("text", "")) for r in p.get("runs") or []) or str(p.get("text") or "")


def _cell(c: dict) -> str:
    # elements mirror the paragraphs where both are there
    inner = [t for e in c.get("elements") or [] for t in _flatten(e)] or [_paragraph(p) for p in c.get("paragraphs") or []]
    return "\n".join(t for t in inner if t)


def hwp5_units(tree: str) -> list[tuple[int, str]]:
    """(number, text) of a parsed document given as JSON: sections of elements, or of paragraphs."""
    doc = json.loads(tree)
    texts = [t for s in doc.get("sections") or [] for e in (s.get("elements") or [{"type": "paragraph", "data": p} for p in s.get("paragraphs") or []]) for t in _flatten(e)]
    return [(i, t.strip()) for i, t in enumerate(texts, 1) if t.strip()]


def file_units(files: DataFrame) -> DataFrame:
    """sourceId, unitIndex, rawText of files (sourceId, format, text) in formats hwpml and hwp5-json; formats that a regular expression can't read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, i, t) for s, f, x in zip(batch["sourceId"], batch["format"], batch["text"], strict=True) for i, t in (hwpml_units(x) if f == "hwpml" else hwp5_units(x))]
            yield pd.DataFrame(out, columns=["sourceId", "unitIndex", "rawText"])

    return files.where(F.col("format").isin("hwpml", "hwp5-json")).select("sourceId", "format", "text").mapInPandas(run, "sourceId string, unitIndex int, rawText string")


def join_items(items: Column) -> Column:
    """Text of a page's items array<struct<str,hasEOL>>: a line end after items that end a line."""
    return trim(F.array_join(F.transform(items, lambda i: F.concat(i["str"], F.when(i["hasEOL"], "\n").otherwise(""))), ""))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n", -1), trim), lambda x: x != "")


def printed_page(text: Column) -> Column:
    """The one number of up to three digits that stands alone in the first or last five lines, else null."""
    lines = _lines(text)
    edge = F.concat(F.slice(lines, 1, 5), F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5))
    numbers = F.array_distinct(F.transform(F.filter(edge, lambda x: x.rlike("^[0-9]{1,3}$")), lambda x: x.cast("int")))
    return F.when(F.size(numbers) == 1, F.try_element_at(numbers, F.lit(1)))


def page_headings(text: Column) -> Column:
    """Of the first two lines those of at most 120 characters."""
    return F.filter(F.slice(_lines(text), 1, 2), lambda x: utf16_length(x) <= 120)


def statute_units(files: DataFrame, addendum: str = CURRENT_ADDENDUM) -> DataFrame:
    """sourceId, unitIndex, article, paragraph, heading, rawText: articles up to the first addendum after the last article, then the one addendum with the marker.

    An addendum's article is 부칙 and its paragraph the marker. Texts without the first or last article are an error.
    """
    text = F.regexp_replace("text", "^\\x{FEFF}", "")
    first, last = F.instr(text, FIRST_ARTICLE), F.instr(text, LAST_ARTICLE)
    at_addendum = rf"(?m)(?=^{ADDENDUM_HEAD})"
    tail = F.element_at(F.split(F.substring(text, last, F.length(text)), at_addendum, -1), 1)
    body = F.when((first > 0) & (last >= first), F.concat(F.substring(text, first, last - first), tail)).otherwise(F.raise_error(F.lit("statute anchors are missing")))
    articles = F.filter(F.split(body, rf"(?m)(?=^{ARTICLE_HEAD})", -1), lambda x: x.rlike(f"^{ARTICLE_HEAD}"))
    addenda = F.filter(F.split(text, at_addendum, -1), lambda x: F.regexp_extract(x, rf"(?m)\A{ADDENDUM_HEAD}", 1) == addendum)

    def unit(x: Column) -> Column:
        return F.struct(F.regexp_extract(x, r"^(제\d+조(?:의\d+)?)", 1).alias("article"), F.lit(None).cast("string").alias("paragraph"), F.regexp_extract(x, f"^({ARTICLE_HEAD})", 1).alias("heading"), trim(x).alias("rawText"))

    def extra(x: Column) -> Column:
        return F.struct(F.lit("부칙").alias("article"), F.lit(addendum).alias("paragraph"), F.lit(f"부칙 <{addendum}>").alias("heading"), trim(x).alias("rawText"))

    rows = files.select("sourceId", F.posexplode(F.concat(F.transform(articles, unit), F.transform(F.slice(addenda, 1, 1), extra))).alias("k", "u"))
    return rows.select("sourceId", (F.col("k") + 1).alias("unitIndex"), "u.*")


def circled_paragraphs(units: DataFrame, column: str = "body") -> DataFrame:
    """Other columns, paragraph (null for what stands before the first mark), body: split at circled numbers that begin the text or a line."""
    rest = [c for c in units.columns if c != column]
    parts = F.split(column, rf"(?m)(?=^[{CIRCLED}])", -1)
    rows = units.select(*rest, F.explode(parts).alias("__p")).withColumn("__b", normalize_corpus(F.col("__p"))).where("__b <> ''")
    number = F.instr(F.lit(CIRCLED), F.substring("__b", 1, 1))
    return rows.select(*rest, F.when(number > 0, number.cast("string")).alias("paragraph"), F.col("__b").alias(column))
