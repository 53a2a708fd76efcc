"""Ranked passage search: a BM25-family score with phrase, compound, heading and coverage parts.

Statistics (size, mean length, document frequencies of the query's tokens) are one aggregate row over all passages,
whatever the filters; the score is a closed expression of a row and that row. One query is one pass for the statistics
and one for the scores, and the top is taken without a full sort. Many queries share an inverted index, whose blocks
have bounds of the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.functions.text import compact, count_in, normalize_search, once, pad_start, snippet, tokens, words
from rulesift.operators.contain import meet
from rulesift.sources.tables import written

# Weights of the score.
EXACT, COMPACT, COVERAGE, HEADING, BM25, CONTAINS, AUTHORITY = 3000.0, 1800.0, 800.0, 500.0, 100.0, 400.0, 0.01
K1, B = 1.2, 0.75
#: Queries up to which ``search_many`` broadcasts what it knows of them, passages in a block of the index, and passages with the rarest token that are tried first, for each result.
MAX_QUERIES, BLOCK, SEEDS = 2000, 4096, 8
#: Pairs of query and passage up to which they go to the passages instead of being joined by a shuffle of both.
MAX_PAIRS = 1 << 18


class QueryError(ValueError):
    """A query, limit or filter outside its bounds."""


def locator_key(locator: Column) -> Column:
    kind = locator["kind"]
    return (
        F.when(kind == "pdf-page", F.concat(F.lit("P:"), pad_start(locator["pdfPage"].cast("string"), 6)))
        .when(kind == "article", F.concat(F.lit("A:"), locator["article"], F.lit(":"), F.coalesce(locator["paragraph"], F.lit(""))))
        .otherwise(F.concat(F.lit("X:"), pad_start(locator["appendix"].cast("string"), 2), F.lit(":"), pad_start(locator["unitIndex"].cast("string"), 6)))
    )


def prepare(passages: DataFrame, compose: bool = True) -> DataFrame:
    """Adds what every query needs of a passage: search form, heading form, distinct tokens and their number. Each is worked out once for a pass; cache or write the table when many queries follow."""
    have = set(passages.columns)
    heading = F.array_join("headingPath", " ") if "headingPath" in have else F.lit("")
    folded = once(passages, __s=normalize_search(F.col("searchText"), compose), __h=normalize_search(heading, compose and "headingPath" in have))
    ready = once(folded, __tokens=tokens(F.col("__s"))).withColumn("__len", F.size("__tokens")).withColumn("__c", compact(F.col("__s")))
    return ready if "authority" in have else ready.withColumn("authority", F.lit(0))


def check_query(query: str, limit: int) -> None:
    if not 1 <= len(query) <= S.MAX_QUERY:
        raise QueryError("query must contain between 1 and 200 characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= S.MAX_LIMIT:
        raise QueryError("limit must be an integer from 1 to 20")


def fold_query(query: str) -> str:
    """The search form of a query, on the driver."""
    import re
    import unicodedata

    x = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", query))
    return re.sub(r" *\n *", "\n", re.sub(r"[\t ]+", " ", x)).lower().strip().strip("﻿").strip()


def query_tokens(folded: str) -> list[str]:
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", folded)
    return list(dict.fromkeys([*words, *(a + b for a, b in zip(words, words[1:], strict=False))]))


def _features(rows: DataFrame, query: Column, toks: Column) -> DataFrame:
    """Rows that match, with the exact phrase's count and each token's, in the query's order."""
    s = F.col("__s")
    matching = rows.where(F.contains(s, query) | F.exists(toks, lambda t: F.contains(s, t)))
    return once(matching, __ex=count_in(s, query), __tf=F.transform(toks, lambda t: count_in(s, t)))


def _score(query: Column, toks: Column, dfs: Column, n: Column, mean: Column) -> Column:
    """The score of a row with features; toks and dfs are arrays in the query's order."""
    h, tight, length, tf = F.col("__h"), F.col("__c"), F.col("__len"), F.col("__tf")

    def term(x: Column, df: Column) -> Column:
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return F.when(x > 0, idf * (x * (K1 + 1)) / (x + K1 * (1 - B + B * length / F.greatest(F.lit(1.0), mean)))).otherwise(0.0)

    bm25 = F.aggregate(F.zip_with(tf, dfs, term), F.lit(0.0), lambda a, x: a + x)  # in the query's order, so that sums agree to the bit
    tight_query = compact(query)
    size = F.greatest(F.lit(1), F.size(toks)).cast("double")
    matched, headed = F.size(F.filter(tf, lambda x: x > 0)), F.size(F.filter(toks, lambda t: F.contains(h, t)))
    compound = count_in(tight, tight_query) * COMPACT + F.when(F.contains(tight, tight_query), CONTAINS).otherwise(0.0)
    return F.col("__ex") * EXACT + compound + matched / size * COVERAGE + headed / size * HEADING + bm25 * BM25 + F.col("authority") * AUTHORITY


def statistics(prepared: DataFrame, toks: list[str]) -> tuple[int, float, list[int]]:
    """Passages, mean number of distinct tokens, and document frequency of each token: one aggregate row."""
    frequencies = [F.count_if(F.array_contains("__tokens", t)).alias(f"t{i}") for i, t in enumerate(toks)]
    row = prepared.agg(F.count("*").alias("passages"), F.coalesce(F.avg("__len"), F.lit(0.0)).alias("mean"), *frequencies).first()
    return row["passages"], row["mean"], [row[f"t{i}"] for i in range(len(toks))]


def search(prepared: DataFrame, query: str, limit: int = S.DEFAULT_LIMIT, key: str = "id", source_ids: list[str] | None = None, roles: list[str] | None = None, sources: DataFrame | None = None, compose: bool = True) -> DataFrame:
    """The best passages of one query. An empty filter list matches nothing, None everything; unknown filters are errors."""
    folded = fold_query(query)
    check_query(folded, limit)
    if roles is not None and set(roles) - set(S.SOURCE_ROLES):
        raise QueryError("sourceRoles contains an unknown source role")
    if source_ids and sources is not None and sources.where(F.col("id").isin(*source_ids)).select("id").distinct().count() < len(set(source_ids)):
        raise QueryError("sourceIds contains an unknown source ID")
    toks = query_tokens(folded)
    n, mean, dfs = statistics(prepared, toks)
    rows = prepared
    if source_ids is not None:
        rows = rows.where(F.col("sourceId").isin(*source_ids) if source_ids else F.lit(False))
    if sources is not None:
        # the sources table describes files, a handful of rows; it is broadcast only while it is small
        dim = sources.select(F.col("id").alias("sourceId"), F.col("title").alias("title"), "role", F.col("sha256").alias("sourceSha256"))
        rows = rows.join(dim, "sourceId")
        if roles is not None:
            rows = rows.where(F.col("role").isin(*roles) if roles else F.lit(False))
    array = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    query, terms = F.lit(folded), array(toks, "string")
    ranked = _features(rows, query, terms).withColumn("score", _score(query, terms, array(dfs, "double"), F.lit(float(n)), F.lit(float(mean))))
    order = [F.desc("score"), F.desc("authority")] + ([F.col("sourceId")] if "sourceId" in ranked.columns else []) + [locator_key(F.col("locator")) if "locator" in ranked.columns else F.col(key)]
    top = ranked.orderBy(*order).limit(limit)
    top = top.withColumn("__f", normalize_search(F.col("text"), compose))
    return top.withColumn("snippet", snippet(F.col("text"), F.col("__f"), F.lit(folded), array(toks, "string"))).drop("__f", "__s", "__h", "__c", "__tokens", "__len", "__ex", "__tf")


def token_df(prepared: DataFrame) -> DataFrame:
    """token, df: passages that have the token."""
    listed = prepared.select(F.explode_outer("__tokens").alias("token")).where("token IS NOT NULL")  # outer: else the tokens are made again for a filter on their number
    return listed.groupBy("token").agg(F.count("*").alias("df"))


# --- many queries: an inverted index ----------------------------------------------------------------------------


@dataclass
class Index:
    """Tables that serve any number of searches; see ``build_index``."""

    passages: DataFrame  # those of prepare, and __no
    postings: DataFrame  # word, block, df (passages), most (occurrences in a passage), shortest (tokens of a passage), entries (no, n, len)
    vocabulary: DataFrame  # word, df
    size: int
    mean: float
    authority: float  # the highest
    headed: bool  # whether passages have headings


def build_index(prepared: DataFrame) -> Index:
    """An inverted index: for each word the passages that have it, in blocks of ``BLOCK`` passages with the bounds that a score needs.

    A query's token is looked for within words. It has letters and digits alone, so each of its occurrences lies in one
    word, and the words of the vocabulary that contain it tell its exact number of occurrences in every passage.
    """
    passages = written(prepared.withColumn("__no", F.monotonically_increasing_id()), "passages")
    # a passage's words are counted where it is: equal ones are neighbours in their order
    ordered = once(passages.select("__no", "__len", "__s"), __w=F.sort_array(words(F.col("__s")))).where(F.size("__w") > 0)
    w, n = F.col("__w"), F.size("__w")
    starts = once(ordered, __from=F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))))
    ends = F.concat(F.slice("__from", 2, F.size("__from")), F.array(n))
    seen = starts.select("__no", "__len", F.inline(F.zip_with("__from", ends, lambda a, b: F.struct(F.get(w, a).alias("word"), (b - a).alias("n")))))
    block = F.call_function("shiftright", F.col("__no"), F.lit(BLOCK.bit_length() - 1))
    listed = seen.groupBy("word", block.alias("block")).agg(F.count("*").alias("df"), F.max("n").alias("most"), F.min("__len").alias("shortest"), F.collect_list(F.struct(F.col("__no").alias("no"), "n", F.col("__len").alias("len"))).alias("entries"))
    postings = written(listed.sortWithinPartitions("word", "block"), "postings")
    vocabulary = postings.groupBy("word").agg(F.sum("df").alias("df"))
    row = passages.agg(F.count("*").alias("n"), F.coalesce(F.avg("__len"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("authority"), F.lit(0)).alias("top"), F.coalesce(F.max(F.col("__h") != ""), F.lit(False)).alias("headed")).first()
    return Index(passages, postings, written(vocabulary, "vocabulary"), row["n"], row["mean"], float(row["top"]), row["headed"])


def _weight(tf: Column, length: Column, idf: Column, index: Index) -> Column:
    """What a token that occurs adds to a score by its occurrences; a little more, where sums of it are bounds."""
    return BM25 * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.lit(max(1.0, float(index.mean)))))


def search_many(prepared: DataFrame, queries: DataFrame, limit: int = S.DEFAULT_LIMIT, key: str = "id", compose: bool = True, index: Index | None = None) -> DataFrame:
    """query_id, key, score, rank for a stated set of queries (query_id, query).

    Scores are those of ``search``. Few passages are scored: those that hold a query's phrase without its blanks, which
    are found by grams, and some that hold its rarest token, give each query a score to beat. Passages without the phrase
    can score no more than the sum of their tokens' bounds; tokens that even together can't reach the score to beat are
    left out, and for the others only those blocks of the index are read, and only those passages scored, whose bounds do.
    Queries without a token are found by their phrase alone. ``index``: one of ``prepared``, else it is made here.
    """
    index = index or build_index(prepared.select(*dict.fromkeys([key, "authority", "__s", "__h", "__c", "__len", "__tokens"])))
    folded = queries.select("query_id", normalize_search(F.col("query"), compose).alias("__q")).where("__q <> ''").distinct()
    asked = written(folded.withColumn("__t", tokens(F.col("__q"))).withColumn("__id", F.monotonically_increasing_id()), "queries")
    few = (lambda df: F.broadcast(df)) if asked.count() <= MAX_QUERIES else (lambda df: df)
    listed = asked.select("__id", F.size("__t").alias("size"), F.posexplode("__t").alias("pos", "token"))
    each = listed.select("token").distinct()
    having = index.passages.select(F.explode("__tokens").alias("token")).join(few(each), "token").groupBy("token").agg(F.count("*").alias("df"))
    within = written(meet(index.vocabulary, "word", each.select(F.col("token").alias("needle"))).select(F.col("needle").alias("token"), "word", "df", count_in(F.col("word"), F.col("needle")).alias("times")), "query-words")
    found = within.groupBy("token").agg(F.sum("df").alias("places"))
    n = F.lit(float(index.size))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = listed.join(having, "token", "left").join(found, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("double"))
    told = written(told.withColumn("idf", idf).withColumn("bound", F.lit(BM25 * (K1 + 1)) * idf + F.lit(COVERAGE) / F.col("size")), "query-tokens")
    dfs = told.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("x")).select("__id", F.transform("x", lambda y: y["df"]).alias("__df"))
    none = F.array().cast("array<double>")
    ready = asked.join(dfs, "__id", "left").withColumn("__df", F.coalesce("__df", none))
    terms, q = F.col("__t"), F.col("__q")

    def scored(pairs: DataFrame) -> DataFrame:
        """The pairs __id, __no (a written table) that match, with the passage's columns that rank them."""
        both = index.passages.join(F.broadcast(pairs) if pairs.count() <= MAX_PAIRS else pairs, "__no").join(few(ready), "__id")
        rows = _features(both, q, terms).withColumn("score", _score(q, terms, F.col("__df"), n, F.lit(float(index.mean))))
        return rows.select("__id", "__no", "query_id", key, "authority", "score")

    def entries(some: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """token, no, len and tf of the tokens ``some``, in the given blocks (token, block)."""
        kept = index.postings.join(few(some.join(within.select("token", "word", "times"), "token")), "word")
        kept = kept if blocks is None else kept.join(few(blocks), ["token", "block"], "left_semi")
        return kept.select("token", "times", F.inline("entries")).groupBy("token", "no", "len").agg(F.sum(F.col("n") * F.col("times")).alias("tf"))

    phrases = asked.select("__id", compact(q).alias("needle"))
    whole = meet(index.passages.select("__no", "__c"), "__c", phrases).select("__id", "__no")
    rarest = told.where("places IS NOT NULL").groupBy("__id").agg(F.min(F.struct("places", "token")).alias("best")).select("__id", F.col("best.token").alias("token"))
    best = F.row_number().over(W.partitionBy("__id").orderBy(F.desc("tf"), "len", "no"))
    some = rarest.join(entries(rarest.select("token").distinct()), "token").withColumn("place", best).where(F.col("place") <= SEEDS * limit)
    tried = written(whole.unionByName(some.select("__id", F.col("no").alias("__no"))).distinct(), "tried")
    first = written(scored(tried), "first-scores")

    kth = F.row_number().over(W.partitionBy("__id").orderBy(F.desc("score")))
    beat = first.withColumn("place", kth).where(F.col("place") == limit).select("__id", F.col("score").alias("beat"))
    slack = AUTHORITY * index.authority + (HEADING if index.headed else 0.0) + 1e-6
    sums = W.partitionBy("__id").orderBy("bound", "pos").rowsBetween(W.unboundedPreceding, 0)
    bounded = told.where("places IS NOT NULL").join(beat, "__id", "left").withColumn("beat", F.coalesce("beat", F.lit(0.0)) - slack).withColumn("sum", F.sum("bound").over(sums))
    # Tokens whose bounds, added up from the least, stay under the score to beat can't bring a passage in by themselves.
    bounded = written(bounded.withColumn("needed", F.col("sum") >= F.col("beat")).withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))).over(W.partitionBy("__id")), F.lit(0.0))).where("needed"), "needed-tokens")
    needed = bounded.select("token").distinct()
    heads = index.postings.join(few(needed.join(within.select("token", "word", "times"), "token")), "word").groupBy("token", "block").agg(F.sum(F.col("most") * F.col("times")).alias("most"), F.min("shortest").alias("shortest"))
    of_block = heads.join(few(bounded), "token").groupBy("__id", "block", "beat", "rest").agg(F.sum(_weight(F.col("most"), F.col("shortest"), F.col("idf"), index) + F.lit(COVERAGE) / F.col("size")).alias("most"), F.collect_set("token").alias("tokens"))
    blocks = written(of_block.where(F.col("most") + F.col("rest") >= F.col("beat")).select("__id", "block", "tokens"), "blocks")
    listed = entries(needed, blocks.select(F.explode("tokens").alias("token"), "block").distinct()).withColumn("block", F.call_function("shiftright", F.col("no"), F.lit(BLOCK.bit_length() - 1)))
    met = listed.join(few(bounded), "token").join(few(blocks.select("__id", "block")), ["__id", "block"], "left_semi")
    summed = met.groupBy("__id", "no", "beat", "rest").agg(F.sum(_weight(F.col("tf"), F.col("len"), F.col("idf"), index) + F.lit(COVERAGE) / F.col("size")).alias("most"))
    left = written(summed.where(F.col("most") + F.col("rest") >= F.col("beat")).select("__id", F.col("no").alias("__no")).join(tried, ["__id", "__no"], "left_anti"), "left")
    every = first.unionByName(scored(left))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("authority"), key))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", key, "score", "rank")
