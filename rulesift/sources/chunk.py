"""From units to passages and corpus documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.functions.text import normalize_corpus, normalize_search, pad_start, sha256_upper, utf16_length
from rulesift.errors import BundleError
from rulesift.operators.integrity import dangling
from rulesift.sources.extract import CIRCLED


# How passages of the known sources are called.
GUIDE_LABEL, STATUTE_LABEL = "2026 초등 기재요령", "교육부훈령 제555호"


def _digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def chunk_id(source_id: Column, locator: Column) -> Column:
    """Id of a passage by where it stands: page, article (with branch and paragraph), addendum, unit. Articles of another form are an error."""
    article, paragraph = locator["article"], locator["paragraph"]
    form = r"^제(\d+)조(?:의(\d+))?$"
    branch = F.nullif(F.regexp_extract(article, form, 2), F.lit(""))
    slug = F.concat(F.lit(":article-"), pad_start(F.regexp_extract(article, form, 1), 2), F.coalesce(F.concat(F.lit("-"), branch), F.lit("")), F.coalesce(F.concat(F.lit("-p"), pad_start(_digits(paragraph), 2)), F.lit("")))
    addendum = F.concat(F.lit(":addendum"), F.coalesce(F.concat(F.lit("-"), F.nullif(F.regexp_extract(paragraph, r"제(\d+)호", 1), F.lit(""))), F.lit("")))
    place = (
        F.when(locator["kind"] == "pdf-page", F.concat(F.lit(":pdf-"), pad_start(locator["pdfPage"].cast("string"), 3)))
        .when((locator["kind"] == "article") & (article == "부칙"), addendum)
        .when((locator["kind"] == "article") & article.rlike(form), slug)
        .when(locator["kind"] == "appendix", F.concat(F.lit(":unit-"), pad_start(locator["unitIndex"].cast("string"), 4)))
        .otherwise(F.raise_error(F.lit("unsupported locator")))
    )
    return F.concat(source_id, place)


def locator_label(locator: Column, guide: str = GUIDE_LABEL, statute: str = STATUTE_LABEL) -> Column:
    pdf = F.concat(F.lit("PDF "), locator["pdfPage"].cast("string"), F.lit("쪽"))
    page = F.when(locator["printedPage"].isNull(), F.concat(F.lit(f"{guide} "), pdf)).otherwise(F.concat(F.lit(f"{guide} 인쇄 "), locator["printedPage"].cast("string"), F.lit("쪽 ("), pdf, F.lit(")")))
    article = F.concat(F.lit(f"{statute} "), locator["article"], F.coalesce(F.concat(F.lit("제"), F.coalesce(_digits(locator["paragraph"]), locator["paragraph"]), F.lit("항")), F.lit("")))
    unit = F.concat(F.lit(f"{statute} 별표 "), locator["appendix"].cast("string"), F.lit(", 단위 "), locator["unitIndex"].cast("string"))
    return F.when(locator["kind"] == "pdf-page", page).when(locator["kind"] == "article", article).otherwise(unit)


def split_paragraphs(units: DataFrame) -> DataFrame:
    """Units of statute bodies split at circled numbers that begin the text or a line; others, addenda among them, stay."""
    locator = F.col("locator")
    splits = (F.col("role") == "directive-body") & (locator["kind"] == "article") & locator["paragraph"].isNull() & ~locator["article"].startswith("부칙")
    parts = F.when(F.coalesce(splits, F.lit(False)), F.split("rawText", rf"(?m)(?=^[{CIRCLED}])", -1)).otherwise(F.array("rawText"))
    rows = units.withColumn("__p", F.explode(parts)).where(F.trim("__p") != "")
    number = F.instr(F.lit(CIRCLED), F.substring("__p", 1, 1))
    paragraph = F.when(F.coalesce(splits, F.lit(False)) & (number > 0), number.cast("string")).otherwise(locator["paragraph"])
    return rows.withColumn("locator", locator.withField("paragraph", paragraph)).withColumn("rawText", F.col("__p")).drop("__p")


def chunks(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages of units; verification copies give none. Ids must be unique and texts must not be empty."""
    dim = sources.select(F.col("id").alias("sourceId"), "title", "role", "authority", "schoolLevels")
    joined = split_paragraphs(units.join(dim, "sourceId").where("role <> 'verification-copy'"))
    text = normalize_corpus(F.col("rawText"))
    rows = joined.withColumn("text", text).where("text <> ''")
    return rows.select(
        chunk_id(F.col("sourceId"), F.col("locator")).alias("id"), "sourceId", "authority", "schoolLevels", "locator", locator_label(F.col("locator")).alias("locatorLabel"), "headingPath", "text",
        normalize_search(F.col("text")).alias("searchText"), sha256_upper(F.col("text")).alias("textSha256"),
    )


def extraction_summary(units: DataFrame) -> DataFrame:
    """sourceId, unitCount, extractedCharCount (UTF-16 units)."""
    return units.groupBy("sourceId").agg(F.count("*").cast("int").alias("unitCount"), F.sum(utf16_length(F.col("rawText"))).cast("int").alias("extractedCharCount"))


def documents(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Corpus documents; sources and extractions must match one to one, and every source must reach its minimum."""
    n = extraction_summary(units)
    both = sources.join(n.withColumnRenamed("sourceId", "__s"), F.col("id") == F.col("__s"), "full_outer")
    if not both.where(F.col("id").isNull() | F.col("__s").isNull()).isEmpty():
        raise BundleError("source-extraction-set", "sources")
    if not both.where(F.col("extractedCharCount") < F.col("minimumExtractedChars")).isEmpty():
        raise BundleError("extraction-floor", "sources")
    return both.select(F.col("id").alias("sourceId"), "title", "role", "format", "authority", "schoolLevels", F.col("sha256").alias("sourceSha256"), "sourceUrl", "snapshotName", "unitCount", "extractedCharCount", (F.col("role") != "verification-copy").alias("includedInChunks"))


def require_unique(passages: DataFrame) -> None:
    if not passages.groupBy("id").count().where("count > 1").isEmpty():
        raise BundleError("duplicate-id", "chunks")


def require_known(passages: DataFrame, sources: DataFrame) -> None:
    if not dangling(passages, "sourceId", sources.select(F.col("id").alias("__s")), "__s").isEmpty():
        raise BundleError("source-chunk-reference", "chunks")
