"""Bibliographic metadata: provider payloads, field-level merge, retractions, title matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Whom to believe first, by field.
_BOOKS = ("crossref", "semantic_scholar", "openalex")
PRIORITY: dict[str, tuple[str, ...]] = {
    "title": _BOOKS,
    "authors": _BOOKS,
    "year": _BOOKS,
    "venue": _BOOKS,
    "doi": _BOOKS,
    "abstract": _BOOKS,
    "citation_count": ("semantic_scholar", "openalex", "crossref"),
    "is_oa": ("openalex", "unpaywall"),
    "oa_url": ("openalex", "unpaywall"),
    "quality_tier": ("openalex",),
}
CONFIDENCE = ("doi", "title", "none")
LEAST_SIMILARITY = 0.8


def _place(value: Column, order: tuple[str, ...]) -> Column:
    found = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(found > 0, found).otherwise(len(order) + 1)


def merge(matches: DataFrame, fields: list[str], least: float = LEAST_SIMILARITY) -> DataFrame:
    """source_key and each field from the provider with the best confidence, then priority, then name.

    matches: source_key, provider, confidence, score and the fields, null where a provider has none.
    Title matches below `least` count for nothing. retracted is true if any provider says so.
    """
    good = matches.where((F.col("confidence") != "title") | (F.col("score") >= least))
    confidence = _place(F.col("confidence"), CONFIDENCE)
    picks = []
    for f in fields:
        if f == "retracted":
            picks.append(F.nullif(F.coalesce(F.bool_or("retracted"), F.lit(False)), F.lit(False)).alias(f))
            continue
        # A struct orders by its parts; rows without the field don't compete.
        rank = F.struct(confidence, _place(F.col("provider"), PRIORITY.get(f, ())), F.col("provider"))
        picks.append(F.min_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f))
    return good.groupBy("source_key").agg(*picks)


def fill(sources: DataFrame, merged: DataFrame, fields: list[str]) -> DataFrame:
    """Sources with their gaps filled; what is there stays, and retracted only turns true."""
    m = merged.select(F.col("source_key").alias("_m"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = sources.join(m, F.col("source_key") == F.col("_m"), "left")
    value = lambda f: (F.coalesce(F.col(f), F.lit(False)) | F.coalesce(F.col(f"_{f}"), F.lit(False))) if f == "retracted" else F.coalesce(f, f"_{f}")
    return joined.select("source_key", *[value(f).alias(f) for f in fields])


def flag_retracted(sources: DataFrame, retractions: DataFrame) -> DataFrame:
    """Sources with retracted by DOI; both sides in canonical form."""
    known = retractions.select(text.normalize_doi(F.col("doi")).alias("_r")).where("_r IS NOT NULL").distinct()
    joined = sources.withColumn("_d", text.normalize_doi(F.col("doi"))).join(known, F.col("_d") == F.col("_r"), "left")
    return joined.withColumn("retracted", F.col("_r").isNotNull()).drop("_d", "_r")


def best_titles(wanted: DataFrame, candidates: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """id, candidate, similarity: the most similar title of `least` and more, the smaller candidate on ties.

    Candidates come from shared title tokens (an inverted index), not from all pairs.
    """
    w = wanted.select("id", text.title_tokens(F.col("title")).alias("a"))
    c = candidates.select(F.col("id").alias("candidate"), text.title_tokens(F.col("title")).alias("b"))
    hits = w.select("id", F.explode("a").alias("t")).join(c.select("candidate", F.explode("b").alias("u")), F.col("t") == F.col("u")).groupBy("id", "candidate").agg(F.count("*").alias("shared"))
    sized = hits.join(w.select("id", F.size("a").alias("na")), "id").join(c.select("candidate", F.size("b").alias("nb")), "candidate")
    scored = sized.withColumn("similarity", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate"))
    return scored.withColumn("rank", rank).where("rank = 1").select("id", "candidate", "similarity")


def _path(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(json, path, kind)


# Years that a work may have.
FIRST_YEAR, LAST_YEAR = 1000, 2999


def _text(json: Column, path: str) -> Column:
    """A string that isn't blank, without blanks around it."""
    return F.nullif(text.strip(_path(json, path)), F.lit(""))


def _year(json: Column, path: str) -> Column:
    """A year in the range that works have, given as a number or as digits."""
    found = F.coalesce(_path(json, path, "int"), _path(json, path).try_cast("int"))
    return F.when(found.between(FIRST_YEAR, LAST_YEAR), found)


def _some(names: Column) -> Column:
    """The names that are there; null if there are none."""
    kept = F.filter(names, lambda n: n.isNotNull() & (F.btrim(n) != ""))
    return F.when(F.size(kept) > 0, kept)


def crossref(payload: Column) -> Column:
    """A work of Crossref as a patch; titles, venues and abstracts without their markup."""
    v = F.try_parse_json(payload)
    names = F.transform(_path(v, "$.author", "array<struct<given string, family string, name string>>"), lambda a: F.coalesce(F.nullif(F.concat_ws(" ", a["given"], a["family"]), F.lit("")), a["name"]))
    first = lambda p: text.strip_markup(F.get(F.filter(_path(v, p, "array<string>"), lambda x: F.btrim(x) != ""), F.lit(0)))
    return F.struct(
        first("$.title").alias("title"),
        F.filter(names, lambda x: x.isNotNull()).alias("authors"),
        _year(v, "$.issued['date-parts'][0][0]").alias("year"),
        text.normalize_doi(_path(v, "$.DOI")).alias("doi"),
        first("$['container-title']").alias("venue"),
        text.strip_markup(_text(v, "$.abstract")).alias("abstract"),
        _path(v, "$['is-referenced-by-count']", "int").alias("citation_count"),
    )


def openalex(payload: Column) -> Column:
    """A work of OpenAlex as a patch; any part of it may be missing or null."""
    v = F.try_parse_json(payload)
    names = F.transform(_path(v, "$.authorships", "array<struct<author struct<display_name string>>>"), lambda a: a["author"]["display_name"])
    return F.struct(
        F.coalesce(_text(v, "$.title"), _text(v, "$.display_name")).alias("title"),
        _some(names).alias("authors"),
        _year(v, "$.publication_year").alias("year"),
        text.normalize_doi(_path(v, "$.doi")).alias("doi"),
        _text(v, "$.primary_location.source.display_name").alias("venue"),
        _path(v, "$.cited_by_count", "int").alias("citation_count"),
        _path(v, "$.open_access.is_oa", "boolean").alias("is_oa"),
        _text(v, "$.open_access.oa_url").alias("oa_url"),
        openalex_tier(payload).alias("quality_tier"),
    )


def unpaywall(payload: Column) -> Column:
    """Whether a work is open, and where, by Unpaywall."""
    v = F.try_parse_json(payload)
    where = F.coalesce(_text(v, "$.best_oa_location.url_for_pdf"), _text(v, "$.best_oa_location.url"))
    return F.struct(_path(v, "$.is_oa", "boolean").alias("is_oa"), where.alias("oa_url"))


def semantic_scholar(payload: Column) -> Column:
    """A paper of Semantic Scholar as a patch."""
    v = F.try_parse_json(payload)
    return F.struct(
        _path(v, "$.title").alias("title"),
        F.filter(F.transform(_path(v, "$.authors", "array<struct<name string>>"), lambda a: a["name"]), lambda x: x.isNotNull()).alias("authors"),
        _year(v, "$.year").alias("year"),
        text.normalize_doi(_path(v, "$.externalIds.DOI")).alias("doi"),
        _path(v, "$.citationCount", "int").alias("citation_count"),
    )


def openalex_tier(payload: Column) -> Column:
    """Quality of a venue from 0 to 3; null without a source or for another kind."""
    v = F.try_parse_json(payload)
    source, kind = _path(v, "$.primary_location.source", "variant"), F.lower(_path(v, "$.primary_location.source.type"))
    doaj = F.coalesce(_path(v, "$.primary_location.source.is_in_doaj", "boolean"), F.lit(False))
    return F.when(source.isNull() | F.is_variant_null(source), None).when(kind.isNull() | (kind == "repository"), 0).when(kind.isin("conference", "proceedings"), 1).when((kind == "journal") & doaj, 3).when(kind == "journal", 2)
