"""Product texts to columns, arrays and graph rows; venue and date in one text; parts of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), x).cast("double")


def technical(text: Column) -> dict[str, Column]:
    """Measured properties of a product text, each null where the text has none."""
    word = lambda p: F.nullif(F.trim(F.regexp_extract(text, rf"(?i){p}[\s:?–-]+([\w ]+?)(?:\s{{2,}}|\n|odou?r|colou?r|appearance|\bph\b|$)", 1)), F.lit(""))
    size = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*[Ll](?:itre|iter)?s?\b"), F.lit(1)), lambda n: F.concat(n, F.lit("L"))))
    first, second = _number(text, r"(?i)\bph\s*[=:]\s*([\d.]*\d)"), _number(text, r"(?i)\bph\s*[=:]\s*[\d.]+\s*[-–]\s*([\d.]*\d)")
    return {
        "ph_min": first, "ph_max": F.coalesce(second, first), "coverage_min": _number(text, r"(?i)coverage[:\s]*([\d.]+)\s*[-–]"), "coverage_max": _number(text, r"(?i)coverage[:\s]*[\d.]+\s*[-–]\s*([\d.]+)\s*sq"),
        "colour": word(r"\bcolou?r"), "odour": word(r"\bodou?r"), "appearance": word("appearance"), "container_sizes": size,
        "specific_gravity": _number(text, r"(?i)(?:specific\s+gravity|density)[:\s]*(\d+(?:\.\d+)?)"), "flash_point": _number(text, r"(?i)flash\s*point[:\s]*(\d+(?:\.\d+)?)\s*°?c"),
        "boiling_point": _number(text, r"(?i)boiling\s*point[:\s]*(\d+(?:\.\d+)?)\s*°?c"), "viscosity": _number(text, r"(?i)viscosity[:\s]*(\d+(?:\.\d+)?)"),
    }


def safety_warnings(text: Column) -> Column:
    both = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)((?:CAUTION|WARNING)[:\s]+[^.]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)(DO NOT\s+[^.]+\.)"), F.lit(1)))
    return F.array_distinct(F.transform(both, lambda x: F.trim(x)))


def incompatible_surfaces(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:do not use (?:on )?|not suitable for(?: use on)? |not for use on )([^.,]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: F.length(x).between(1, 99)))


def severity(sentence: Column) -> Column:
    low = F.lower(sentence)
    return F.when(low.rlike("never|must not|danger|do not"), "high").when(low.rlike("avoid|not suitable|not recommended"), "medium").otherwise("low")


def dilutions(text: Column) -> Column:
    """Distinct ratios such as 1:40."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+:\d+)"), F.lit(1)))


def keyword_features(df: DataFrame, id: str, text: str, table: dict[str, list[str]]) -> DataFrame:
    """<id>, feature: the features of which a text holds any keyword."""
    hits = F.array_compact(F.array(*[F.when(F.lower(text).rlike("|".join(ws)), F.lit(f)) for f, ws in table.items()]))
    return df.select(id, F.explode(hits).alias("feature"))


def product_graph(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of products (name, brand, categories as slash paths, surfaces): manufactured_by,
    belongs_to_category, subcategory_of, incompatible_with."""
    p = products.withColumn("id", T.slug(F.col("name"), "product_"))
    path = p.select("id", F.explode_outer("categories").alias("c")).where("c is not null")
    leaf = path.select(F.col("id").alias("src"), T.slug(F.col("c"), "category_").alias("dst"), F.lit("belongs_to_category").alias("relation_type"))
    prefix = path.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("c", "/"))), lambda i: F.array_join(F.slice(F.split("c", "/"), 1, i), "/"))).alias("c")).distinct()
    up = prefix.where(F.contains("c", F.lit("/"))).select(T.slug(F.col("c"), "category_").alias("src"), T.slug(F.regexp_replace("c", "/[^/]*$", ""), "category_").alias("dst"), F.lit("subcategory_of").alias("relation_type"))
    brand = p.where("brand is not null").select(F.col("id").alias("src"), T.slug(F.col("brand"), "brand_").alias("dst"), F.lit("manufactured_by").alias("relation_type"))
    surface = p.select(F.col("id").alias("src"), F.explode("surfaces").alias("s")).select("src", T.slug(F.col("s"), "surface_").alias("dst"), F.lit("incompatible_with").alias("relation_type"))
    relations = reduce(DataFrame.unionByName, [leaf, up, brand, surface]).distinct()
    names = relations.select(F.explode(F.array("src", "dst")).alias("name")).union(p.select("id")).distinct()
    return names.select("name", F.split_part("name", F.lit("_"), F.lit(1)).alias("entity_type")), relations


_M = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Phrases that name a release rather than a place, and words that speak for a place.
RELEASE = r"in\s+cinemas?|in\s+theaters?|in\s+theatres?|only\s+(?:in\s+)?(?:cinemas?|theaters?|theatres?)|coming\s+to\s+(?:cinemas?|theaters?|theatres?)|on\s+(?:dvd|blu-?ray|streaming|netflix|amazon|hulu)"
PLACES = (
    "arena", "stadium", "theatre", "theater", "hall", "center", "centre", "club", "bar", "pub", "lounge", "room", "auditorium", "amphitheater", "amphitheatre", "pavilion", "garden", "gardens",
    "park", "field", "coliseum", "dome", "forum", "palace", "house", "ballroom", "showroom", "casino", "hotel", "resort", "cinema", "cinemas", "multiplex",
)
_NAMED = rf"{_M}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)?\s+{_M}(?:\s+\d{{4}})?"
_FIGURES = r"\d{1,2}[/-]\d{1,2}[/-](?:\d{4}|\d{2})"
_DAY_MONTH = r"\d{1,2}[/-]\d{1,2}"


def _dated(text: Column) -> Column:
    """DD/MM[/YYYY] of a whole text that is a date, in words or figures; days up to 31, months up to 12."""

    def read(t: Column) -> Column:
        d, m = (F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})$", g) for g in (1, 2))
        part = F.when(t.rlike(rf"^{_DAY_MONTH}$") & d.try_cast("int").between(1, 31) & m.try_cast("int").between(1, 12), F.concat(F.lpad(d, 2, "0"), F.lit("/"), F.lpad(m, 2, "0")))
        return F.coalesce(part, F.when(t.rlike(rf"(?i)^(?:{_NAMED}|{_FIGURES})$"), T.normalise_date(t)))

    return T.let(text, read)


def split_venue_date(df: DataFrame, column: str) -> DataFrame:
    """`df` with venue, date (DD/MM[/YYYY]), venue_year and venue_confidence of a text that may hold both: 0.9 for a release
    phrase with a date, 0.85 for a date in words at the end, 0.9 in figures, 0.8 without its year; 0.8 for a date alone
    (no venue), 1.0 for a venue alone, 0 for nothing."""
    c = F.trim(F.col(column))

    def ending(kind: str, confidence: float, front: str = ".+?") -> Column:
        p = rf"(?i)^({front})\s+({kind})$"
        date = F.when(c.rlike(p), _dated(F.trim(F.regexp_extract(c, p, 2))))
        return T.let(date, lambda x: F.when(x.isNotNull(), F.struct(F.trim(F.regexp_extract(c, p, 1)).alias("venue"), x.alias("date"), F.lit(confidence).alias("confidence"))))

    made = lambda v, d, x: F.struct(v.cast("string").alias("venue"), d.cast("string").alias("date"), F.lit(x).alias("confidence"))
    alone = F.when(~F.lower(c).rlike("|".join(PLACES)), T.let(_dated(c), lambda x: F.when(x.isNotNull(), made(F.lit(None), x, 0.8))))
    nothing = F.when(F.coalesce(c == "", F.lit(True)), made(F.lit(None), F.lit(None), 0.0))
    found = F.coalesce(nothing, ending(".+", 0.9, RELEASE), ending(_NAMED, 0.85), ending(_FIGURES, 0.9), ending(_DAY_MONTH, 0.8), alone, made(c, F.lit(None), 1.0))
    d = df.withColumn("_lw_split", found)
    year = F.nullif(F.substring("_lw_split.date", 7, 4), F.lit(""))
    return d.withColumns({"venue": F.col("_lw_split.venue"), "date": F.col("_lw_split.date"), "venue_year": year.cast("int"), "venue_confidence": F.col("_lw_split.confidence")}).drop("_lw_split")


def date_parts(s: Column, pivot: int = 30) -> Column:
    """struct(day, month, year, confidence): 0.9 for a whole date, 0.7 for a part."""
    d = T.normalise_date(s, pivot)
    part = lambda a, n: F.nullif(F.substring(d, a, n), F.lit("")).cast("int")
    return F.when(d.isNotNull(), F.struct(part(1, 2).alias("day"), part(4, 2).alias("month"), part(7, 4).alias("year"), F.when(F.length(d) == 10, 0.9).otherwise(0.7).alias("confidence")))


def locale_date(s: Column, day_first: Column) -> Column:
    """The date of 01/02/2003, read by locale; null if there is none."""
    return F.when(day_first, F.try_to_date(s, "dd/MM/yyyy")).otherwise(F.try_to_date(s, "MM/dd/yyyy"))


def artist_confidence(headliner: Column, validated: Column, supports: Column) -> Column:
    """0.6 of the headliner's confidence, 0.1 if validated elsewhere, 0.3 of the supports' mean (0.5 without any)."""
    mean = F.when(F.size(supports) > 0, F.aggregate(supports, F.lit(0.0), lambda a, x: a + x) / F.size(supports)).otherwise(0.5)
    return F.least(F.lit(1.0), F.coalesce(headliner * 0.6 + F.when(validated, 0.1).otherwise(0.0), F.lit(0.0)) + mean * 0.3)


def document_graph(chunks: DataFrame, id: str) -> DataFrame:
    """src, dst, relation_type of documents and their chunks: contains_chunk, chunk_of, followed_by."""
    doc = F.concat(F.lit("doc_"), F.col(id).cast("string"))
    at = lambda i: F.concat(doc, F.lit("_chunk_"), i.cast("string"))
    c = chunks.select(doc.alias("d"), at(F.col("chunk_index")).alias("c"), at(F.lead("chunk_index").over(W.partitionBy(id).orderBy("chunk_index"))).alias("n"))
    rows = F.explode(F.array(F.struct(F.col("d").alias("src"), F.col("c").alias("dst"), F.lit("contains_chunk").alias("relation_type")), F.struct(F.col("c").alias("src"), F.col("d").alias("dst"), F.lit("chunk_of").alias("relation_type")), F.struct(F.col("c").alias("src"), F.col("n").alias("dst"), F.lit("followed_by").alias("relation_type"))))
    return c.select(rows.alias("x")).select("x.*").where("dst is not null")
