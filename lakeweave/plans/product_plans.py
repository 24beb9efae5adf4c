"""Queries of product texts, venue dates and document parts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import products as P
from ..operators import sections as SE
from .registry import plan, table


def _sheet():
    k = F.col("p_partkey")
    return F.concat(F.lit("pH: "), (k % 7 + 1).cast("string"), F.lit(" - "), (k % 7 + 3).cast("string"), F.lit("\nColour: "), F.get(F.split("p_name", " "), F.lit(0)), F.lit("\nDensity: 1."), (k % 10).cast("string"), F.lit("\nAvailable in 5L and 20L.\nCAUTION: keep cool. DO NOT use on "), F.lower("p_type"), F.lit(". Dilute 1:"), (k % 50 + 1).cast("string"), F.lit(" for floors."))


@plan("SELECT p_partkey, (p_partkey % 7 + 1)::DOUBLE AS ph_min, (p_partkey % 7 + 3)::DOUBLE AS ph_max, split_part(p_name, ' ', 1) AS colour, 1 + (p_partkey % 10) / 10 AS specific_gravity, '5L|20L' AS sizes FROM part")
def txt7_technical(spark, d):
    t = P.technical(F.col("s"))
    s = table(spark, d, "part").select("p_partkey", _sheet().alias("s"))
    return s.select("p_partkey", t["ph_min"].alias("ph_min"), t["ph_max"].alias("ph_max"), t["colour"].alias("colour"), t["specific_gravity"].alias("specific_gravity"), F.array_join(t["container_sizes"], "|").alias("sizes"))


@plan("SELECT p_partkey, 'CAUTION: keep cool|DO NOT use on ' || lower(p_type) || '.' AS warnings, lower(p_type) AS surfaces, '1:' || (p_partkey % 50 + 1) AS ratios FROM part")
def txt6_features(spark, d):
    s = table(spark, d, "part").select("p_partkey", _sheet().alias("s"))
    return s.select("p_partkey", F.array_join(P.safety_warnings(F.col("s")), "|").alias("warnings"), F.array_join(P.incompatible_surfaces(F.col("s")), "|").alias("surfaces"), F.array_join(P.dilutions(F.col("s")), "|").alias("ratios"))


@plan("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM part")
def txt9_severity(spark, d):
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", P.severity(F.when(k == 0, "Never use on brass").when(k == 1, "Avoid marble").otherwise("Test first")).alias("severity"))


@plan("SELECT p_partkey, f AS feature FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN regexp_matches(lower(p_type), 'small|medium|large') THEN 'sized' END, CASE WHEN regexp_matches(lower(p_type), 'economy|promo') THEN 'cheap' END], lambda x: x IS NOT NULL)) AS f FROM part)")
def txt10_keywords(spark, d):
    return P.keyword_features(table(spark, d, "part"), "p_partkey", "p_type", {"sized": ["small", "medium", "large"], "cheap": ["economy", "promo"]})


_S = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


@plan(f"""WITH p AS (SELECT 'product_' || {_S.format("p_name || ' ' || p_partkey")} AS id, p_brand, replace(p_type, ' ', '/') AS c FROM part),
x AS (SELECT DISTINCT array_to_string(string_split(c, '/')[1:i], '/') AS c FROM p, range(1, 6) r(i) WHERE i <= len(string_split(c, '/')))
SELECT id AS src, 'brand_' || {_S.format('p_brand')} AS dst, 'manufactured_by' AS relation_type FROM p UNION SELECT id, 'category_' || {_S.format('c')}, 'belongs_to_category' FROM p
UNION SELECT 'category_' || {_S.format('c')}, 'category_' || {_S.format("regexp_replace(c, '/[^/]*$', '')")}, 'subcategory_of' FROM x WHERE contains(c, '/')""")
def txt11_product_graph(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("brand"), F.array(F.regexp_replace("p_type", " ", "/")).alias("categories"), F.array().cast("array<string>").alias("surfaces"))
    return P.product_graph(p)[1]


@plan("""WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderdate AS t, c_name || CASE WHEN o_custkey % 2 = 0 THEN ' Hall' ELSE '' END AS v FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE k WHEN 0 THEN 'In cinemas' WHEN 6 THEN NULL ELSE v END AS venue,
  CASE WHEN k = 7 THEN NULL WHEN k IN (3, 4) THEN strftime(t, '%d/%m') ELSE strftime(t, '%d/%m/%Y') END AS date, CASE WHEN k IN (3, 4, 7) THEN NULL ELSE year(t) END AS year,
  [0.9, 0.85, 0.9, 0.8, 0.85, 0.9, 0.8, 1.0][k + 1]::DOUBLE AS confidence FROM x""")
def fn16_venue_date(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 8
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    v = F.concat("c_name", F.when(F.col("o_custkey") % 2 == 0, " Hall").otherwise(""))
    forms = [F.concat(F.lit("In cinemas "), f("MMMM d, yyyy")), F.concat(v, f(" MMMM d yyyy")), F.concat(v, f(" dd/MM/yyyy")), F.concat(v, f(" d-M")), F.concat(v, f(" d MMM")), F.concat(v, f(" dd-MM-yy")), f("dd/MM/yyyy"), v]
    out = P.split_venue_date(j.select("o_orderkey", F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)]).alias("raw")), "raw")
    return out.select("o_orderkey", "venue", "date", F.col("venue_year").alias("year"), F.col("venue_confidence").alias("confidence"))


@plan("SELECT o_orderkey, day(o_orderdate) AS day, month(o_orderdate) AS month, year(o_orderdate) AS year, 0.9 AS confidence FROM orders")
def fn17_parts(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", P.date_parts(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("p"))
    return p.select("o_orderkey", "p.day", "p.month", "p.year", "p.confidence")


@plan("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS read FROM orders")
def fn18_locale(spark, d):
    k = F.col("o_orderkey") % 2 == 0
    raw = F.when(k, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", P.locale_date(raw, k).cast("string").alias("read"))


@plan("SELECT event_id, round(least(1, value / 1000 * 0.6 + CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0.5 ELSE 0.4 END * 0.3), 8) AS confidence FROM events")
def dq7_artist_confidence(spark, d):
    s = F.when(F.col("user_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.3), F.lit(0.5)))
    return table(spark, d, "events").select("event_id", F.round(P.artist_confidence(F.col("value") / 1000, F.col("user_id") % 2 == 0, s), 8).alias("confidence"))


def _sheets(spark, d):
    """Every document as a product sheet: before each fourth line a heading, pages of eight lines."""
    from ..operators.sections import HEADINGS

    heads = F.array(*[F.lit(h.replace(".+", "it").replace("\\", "")) for h, _ in HEADINGS])
    line = lambda x, i: F.concat(F.when((i > 0) & (i % 8 == 0), "\f").otherwise(""), F.when(i % 4 == 0, F.concat(F.element_at(heads, (F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) + i, F.lit(len(HEADINGS))) + 1).cast("int")), F.lit("\n"))).otherwise(""), x)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@plan()
def txt3_sections(spark, d):
    s = SE.sections(_sheets(spark, d))
    return s.select("doc_id", "section", "page", "kind", "heading", F.md5("content").alias("content"), "start", "end", "n_tokens")


@plan("""WITH w AS (SELECT doc_id, len(string_split_regex(text, '\\s+')) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(range(0, greatest(0, floor((n - 533) / 483.0)::INT + 1) + 1)) AS k, n FROM w), k AS (SELECT 'doc_' || doc_id AS d, doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nx FROM c WHERE k * 483 < n)
SELECT d AS src, d || '_chunk_' || k AS dst, 'contains_chunk' AS relation_type FROM k UNION ALL SELECT d || '_chunk_' || k, d, 'chunk_of' FROM k UNION ALL SELECT d || '_chunk_' || k, d || '_chunk_' || nx, 'followed_by' FROM k WHERE nx IS NOT NULL""")
def txt4_document_graph(spark, d):
    return P.document_graph(D.word_chunks(table(spark, d, "documents")), "doc_id")
