"""Queries of names, dates, texts, search, quality and consensus over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import keywords as K
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import search as S
from ..operators import sections as SE
from ..sources.scratch import cut
from .derived import ENT, entities
from .registry import plan, table

# Dates as text: each order's date in one of sixteen spellings, some without a year and some that are none.
_SPELL = """spelled AS (SELECT o_orderkey, CASE o_orderkey % 16 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y')
  WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 4 THEN strftime(o_orderdate, '%d.%m.%y') WHEN 5 THEN 'Until ' || strftime(o_orderdate, '%-d %b %Y') || ' (noted)' WHEN 6 THEN strftime(o_orderdate, '%d-%m-%y')
  WHEN 7 THEN strftime(o_orderdate, '%d/%m-%y') WHEN 8 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 9 THEN strftime(o_orderdate, '%A %-d %B') WHEN 10 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 11 THEN strftime(o_orderdate, '%-d %B %y')
  WHEN 12 THEN strftime(o_orderdate, '%B %-d %y') WHEN 13 THEN strftime(o_orderdate, '%-d %b. %y') WHEN 14 THEN strftime(o_orderdate, '%b %-d') || CASE day(o_orderdate) WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END ELSE strftime(o_orderdate, '31/02/%Y') END AS raw,
  CASE WHEN o_orderkey % 16 = 15 THEN NULL WHEN o_orderkey % 16 IN (9, 14) THEN strftime(o_orderdate, '%d/%m') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS clean, year(o_orderdate) AS y FROM orders)"""


def _spelled(spark, d):
    o = table(spark, d, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    k, day = F.col("o_orderkey") % 16, F.dayofmonth("o_orderdate")
    ordinal = F.when(day == 1, "st").when(day == 2, "nd").when(day == 3, "rd").otherwise("th")
    forms = [
        f("yyyy-MM-dd"), f("dd/MM/yyyy"), f("d MMMM yyyy"), f("MMMM d, yyyy"), f("dd.MM.yy"), F.concat(F.lit("Until "), f("d MMM yyyy"), F.lit(" (noted)")), f("dd-MM-yy"), f("dd/MM-yy"),
        f("dd.MM.yyyy"), f("EEEE d MMMM"), f("MMM d, yyyy"), f("d MMMM yy"), f("MMMM d yy"), f("d MMM. yy"), F.concat(f("MMM d"), ordinal), F.concat(F.lit("31/02/"), f("yyyy")),
    ]
    return o.select("o_orderkey", F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)]).alias("raw"))


@plan(f"WITH {_SPELL} SELECT o_orderkey, raw, clean FROM spelled")
def fn12_normalise_dates(spark, d):
    return _spelled(spark, d).select("o_orderkey", "raw", T.normalise_date(F.col("raw")).alias("clean"))


@plan(f"WITH {_SPELL} SELECT o_orderkey, CASE WHEN regexp_matches(raw, '(19|20)[0-9][0-9]') THEN y END AS year, CASE WHEN regexp_matches(raw, '(19|20)[0-9][0-9]') THEN (y // 10 * 10) || 's' END AS decade FROM spelled")
def fn13_year(spark, d):
    y = T.extract_year(F.col("raw"))
    return _spelled(spark, d).select("o_orderkey", y.alias("year"), T.decade(y).alias("decade"))


@plan("SELECT o_orderkey, dayname(o_orderdate) AS weekday FROM orders")
def fn14_weekday(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.weekday(F.concat(F.lit("on "), F.date_format("o_orderdate", "EEEE d MMMM"))).alias("weekday"))


@plan("SELECT o_orderkey, unnest(CASE WHEN day(o_orderdate) <= 20 THEN range(day(o_orderdate), day(o_orderdate) + 4) ELSE [day(o_orderdate)] END) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS one FROM orders")
def fn15_expand_dates(spark, d):
    o = table(spark, d, "orders")
    day = F.dayofmonth("o_orderdate")
    raw = F.when(day <= 20, F.concat(day.cast("string"), F.lit("-"), (day + 3).cast("string"), F.date_format("o_orderdate", " MMMM yyyy"))).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return o.select("o_orderkey", F.explode(T.expand_dates(raw)).alias("one"))


@plan("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS local FROM orders")
def fn19_iso(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.iso_to_local(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("local"))


@plan("SELECT DISTINCT c_name, regexp_replace(regexp_replace(lower('The ' || c_name || ' Band!'), '^(the|a|an)\\s+', ''), '[^A-Za-z0-9_\\s]', '', 'g') AS normal FROM customer")
def fn1_normalise(spark, d):
    return table(spark, d, "customer").select("c_name", T.normalise(F.concat(F.lit("The "), "c_name", F.lit(" Band!"))).alias("normal")).distinct()


@plan("SELECT DISTINCT c_name, regexp_replace(lower(c_name), '[^A-Za-z0-9_\\s]', '', 'g') || ' band' AS artist FROM customer")
def fn2_normalise_artist(spark, d):
    return table(spark, d, "customer").select("c_name", T.normalise_artist(F.concat(F.lit("The "), "c_name", F.lit(" Band feat. Someone"))).alias("artist")).distinct()


_PAIRS = "pairs AS (SELECT a, b FROM (SELECT p_name AS a, lead(p_name) OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_name) AS b FROM (SELECT DISTINCT p_name FROM part)) WHERE b IS NOT NULL)"
_JW = "(jaro_similarity(a, b) + 0.1 * (1 - jaro_similarity(a, b)) * (CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE least(4, length(a), length(b)) END))"


def _name_pairs(spark, d):
    """Each name and the next one, by order, of the same first word: as many pairs as names."""
    p = table(spark, d, "part").select("p_name").distinct()
    w = W.partitionBy(F.split_part("p_name", F.lit(" "), F.lit(1))).orderBy("p_name")
    return p.select(F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).where("b is not null")


@plan(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 8) AS similarity FROM pairs")
def fn3_levenshtein(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(T.levenshtein_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))


@plan(f"WITH {_PAIRS} SELECT a, b, round({_JW}, 8) AS similarity FROM pairs")
def fn4_jaro_winkler(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.round(T.jaro_winkler("a", "b"), 8).alias("similarity"))


@plan(f"WITH {_PAIRS}, s AS (SELECT a, b, least(1, {_JW} * 0.6 + (1 - levenshtein(a, b) / greatest(length(a), length(b))) * 0.4 + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.1 ELSE 0 END) AS s FROM pairs) SELECT a, b, round(s, 8) AS score, CASE WHEN s >= 0.9 THEN 'match' WHEN s >= 0.7 THEN 'partial' ELSE 'mismatch' END AS status FROM s")
def fn5_combined(spark, d):
    s = _name_pairs(spark, d).withColumn("jw", T.jaro_winkler("a", "b")).withColumn("s", T.combined_similarity(F.col("a"), F.col("b"), F.col("jw")))
    return s.select("a", "b", F.round("s", 8).alias("score"), T.match_status(F.col("s")).alias("status"))


@plan("SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'match' WHEN value / 100 >= 0.7 THEN 'partial' ELSE 'mismatch' END AS status FROM events")
def fn6_status(spark, d):
    return table(spark, d, "events").select("event_id", T.match_status(F.col("value") / 100).alias("status"))


@plan("SELECT p_partkey, name FROM (SELECT p_partkey, unnest([p_name, p_brand, trim(p_type)]) AS name FROM part) WHERE length(name) BETWEEN 2 AND 100 AND NOT regexp_matches(lower(name), 'tickets|admission|doors|show|starts|ages|presented by|with special guest|featuring|live at|appearing at')")
def fn7_split_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(T.candidate_names(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" & tickets at the door | "), "p_type"))).alias("name"))


@plan(f"WITH {_PAIRS}, n AS (SELECT a, b, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS y FROM pairs) SELECT a, b, round(CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 8) AS confidence FROM n")
def fn8_title(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.round(T.title_confidence(F.col("a"), F.col("b")), 8).alias("confidence"))


@plan("SELECT p_partkey, 'part_' || trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def fn9_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_type", "p_brand"), "part_").alias("slug"))


_COMM = "|".join(T.COMMENTARY).replace("\\", "\\")


@plan(f"SELECT doc_id, regexp_matches(lower(text), '{_COMM}') AS commentary, length(text) > 100 AS too_long FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def fn10_predicates(spark, d):
    return table(spark, d, "documents").where("text is not null and trim(text) != ''").select("doc_id", T.is_commentary(F.col("text")).alias("commentary"), (F.length("text") > 100).alias("too_long"))


@plan("SELECT c_custkey, c_name AS value, c_mktsegment AS note FROM customer")
def fn11_commentary(spark, d):
    v, n = T.split_commentary(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")))
    return table(spark, d, "customer").select("c_custkey", v.alias("value"), n.alias("note"))


@plan("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS cleaned FROM customer")
def fn20_clean(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit("Not specified")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", T.clean_text(raw).alias("cleaned"))


@plan("SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS suspicious FROM customer")
def fn21_concatenated(spark, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" & others"))).when(F.col("c_custkey") % 3 == 0, F.lit("Ann Bob and Cid")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.looks_concatenated(raw).alias("suspicious"))


@plan(f"WITH {ENT}, o AS (SELECT name, unnest(observations) AS o FROM entities WHERE entity_type IN ('part', 'customer')) SELECT name, split_part(o, ': ', 1) AS key, substr(o, length(split_part(o, ': ', 1)) + 3) AS value FROM o")
def fn22_observations(spark, d):
    o = entities(spark, d, ("part", "customer")).select("name", F.explode("observations").alias("o"))
    return o.select("name", F.regexp_extract("o", r"^([^:]+):\s*(.*)$", 1).alias("key"), F.regexp_extract("o", r"^([^:]+):\s*(.*)$", 2).alias("value"))


@plan("SELECT event_id, json_valid(props) AS parsed FROM events WHERE props IS NOT NULL")
def fn23_parse(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", F.try_parse_json("props").isNotNull().alias("parsed"))


@plan("SELECT c_custkey, c_name AS title, c_mktsegment AS venue FROM customer")
def fn24_lax_json(spark, d):
    lax = F.concat(F.lit("Here it is: {title: '"), "c_name", F.lit("', venue: '"), "c_mktsegment", F.lit("',} done"))
    body = F.regexp_replace(F.regexp_extract(lax, r"\{.*\}", 0), r",\s*\}", "}")
    j = F.from_json(body, "title string, venue string", {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    return table(spark, d, "customer").select("c_custkey", j["title"].alias("title"), j["venue"].alias("venue"))


@plan("SELECT c_custkey, c_name AS title, c_mktsegment AS venue, c_acctbal > 0 AS flag FROM customer")
def fn25_labelled(spark, d):
    t = F.concat(F.lit("Title: "), "c_name", F.lit("\nVenue: "), "c_mktsegment", F.lit("\nPaid: "), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no"))
    g = lambda k: F.regexp_extract(t, rf"(?m)^{k}:\s*(.*)$", 1)
    return table(spark, d, "customer").select("c_custkey", g("Title").alias("title"), g("Venue").alias("venue"), (F.lower(g("Paid")) == "yes").alias("flag"))


@plan("SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' WHEN value / 100 >= 0.5 THEN 'low' ELSE 'very-low' END AS level FROM events")
def fn27_level(spark, d):
    return table(spark, d, "events").select("event_id", T.confidence_level(F.col("value") / 100).alias("level"))


@plan("SELECT c_custkey, round((2 + 2 * (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT) / 5.0, 8) AS complete FROM customer")
def fn28_completeness(spark, d):
    k = F.col("c_custkey")
    c = Q.completeness([F.col("c_name"), F.when(k % 2 == 0, F.col("c_mktsegment"))], [F.when(k % 3 == 0, F.col("c_acctbal"))])
    return table(spark, d, "customer").select("c_custkey", F.round(c, 8).alias("complete"))


@plan(f"WITH {ENT} SELECT name, 'Name: ' || name || chr(10) || 'Type: ' || entity_type || chr(10) || 'Observations:' || chr(10) || array_to_string(observations, chr(10)) AS text FROM entities WHERE entity_type IN ('part', 'order')")
def fn29_embedding_text(spark, d):
    return entities(spark, d, ("part", "order")).select("name", T.embedding_text(F.col("name"), F.col("entity_type"), F.col("observations")).alias("text"))


# Vectors and search.
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark, d):
    """The stated query set: every row whose id is divisible by 50."""
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


_KNN = f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {{score}} AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id {{where}}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"


def _rounded(df):
    return df.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@plan(_KNN.format(score="list_cosine_similarity(v.e, q.e)", where=""))
def vec1_cosine(spark, d):
    return _rounded(S.knn(_queries(spark, d), _vectors(spark, d), 10))


@plan(_KNN.format(score="1 - list_distance(v.e, q.e)", where=""))
def vec1_l2(spark, d):
    return _rounded(S.knn(_queries(spark, d), _vectors(spark, d), 10, "l2"))


@plan(_KNN.format(score="list_inner_product(v.e, q.e)", where="AND v.label % 2 = 0"))
def vec1_inner_filtered(spark, d):
    return _rounded(S.knn(_queries(spark, d), _vectors(spark, d), 10, "inner", where=F.col("label") % 2 == 0))


@plan(_KNN.format(score="list_cosine_similarity(v.e, q.e)", where="AND list_cosine_similarity(v.e, q.e) >= 0.3"))
def vec4_semantic(spark, d):
    return _rounded(S.knn(_queries(spark, d), _vectors(spark, d), 10, least=0.3))


@plan(_KNN.format(score="list_cosine_similarity(v.e, q.e)", where="").replace("<= 10", "<= 3"))
def srt2_knn(spark, d):
    return _rounded(S.knn(_queries(spark, d), _vectors(spark, d), 3))


@plan("SELECT vec_id AS id, len(embedding) AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS most, round(list_avg(embedding::DOUBLE[]), 6) AS mean, true AS valid FROM embeddings")
def fn26_profile(spark, d):
    p = S.vector_profile(_vectors(spark, d))
    return p.select("id", "dim", *[F.round(c, 6).alias(c) for c in ("norm", "least", "most", "mean")], "valid")


@plan("SELECT label, count(*) AS n, min(len(embedding)) AS dim, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label")
def vec6_health(spark, d):
    v = _vectors(spark, d)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"), F.round(F.avg(S.norm(F.col("embedding"))), 6).alias("mean_norm"))


@plan("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def vec7_missing(spark, d):
    have = table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(have, "doc_id", "left_anti")


_LISTS = f"""WITH {_V}, kq AS MATERIALIZED (SELECT doc_id AS query_id, lower(regexp_extract(text, '[A-Za-z]{{7,}}')) AS w FROM documents WHERE doc_id % 50 = 0),
kw AS MATERIALIZED (SELECT query_id, 'doc_' || doc_id AS name, 1.0::DOUBLE AS score FROM kq JOIN documents ON w <> '' AND (contains('doc_' || doc_id, w) OR contains(lower(source), w) OR contains(lower(text), w)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 'doc_' || doc_id) <= 20),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS name, list_cosine_similarity(v.e, q.e) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS k FROM s) WHERE k <= 20),
vs AS MATERIALIZED (SELECT query_id, 'doc_' || name AS name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'doc_' || name) AS k FROM vl)"""


def _keywords(spark, d):
    """The first long word of each document whose id is divisible by 50, searched in all documents."""
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "[A-Za-z]{7,}", 0).alias("text"))
    found = docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("entity_type"), F.array("text").alias("observations"))
    return K.keyword_search(asked, found, limit=20)


def _nearest(spark, d):
    return S.knn(_queries(spark, d), _vectors(spark, d), 20).select("query_id", F.col("id").alias("name"), "score")


def _lists(spark, d):
    """Both lists of 20; a document's vector is that of its id."""
    near = _nearest(spark, d).withColumn("name", F.concat(F.lit("doc_"), F.col("name").cast("string")))
    return cut(_keywords(spark, d)), cut(near)


@plan(f"{_LISTS} SELECT query_id, name, score FROM kw")
def srch1_keyword(spark, d):
    return _keywords(spark, d)


@plan(f"{_LISTS} SELECT query_id, name, round(score, 6) AS score FROM vl")
def srch2_vector(spark, d):
    return _nearest(spark, d).withColumn("score", F.round("score", 6))


_FUSED = "fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.name, b.name) AS name, coalesce(a.score * 0.4, 0) + coalesce(b.score * 0.6, 0) AS score, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'hybrid' WHEN a.name IS NOT NULL THEN 'graph' ELSE 'vector' END AS source FROM kw a FULL JOIN vs b ON a.query_id = b.query_id AND a.name = b.name)"


@plan(f"{_LISTS}, {_FUSED} SELECT query_id, name, round(score, 6) AS score, source FROM fused")
def srch3_hybrid(spark, d):
    return S.fuse_weighted(*_lists(spark, d)).withColumn("score", F.round("score", 6))


@plan(f"{_LISTS}, l AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) - 1 AS r FROM kw UNION ALL SELECT query_id, name, k - 1 FROM vs), f AS (SELECT query_id, name, sum(1 / (60.0 + r + 1)) AS score FROM l GROUP BY ALL) SELECT query_id, name, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM f QUALIFY rank <= 10")
def srch4_rrf(spark, d):
    return S.search(*_lists(spark, d), "rrf").withColumn("score", F.round("score", 8))


@plan(f"{_LISTS}, {_FUSED}, p AS (SELECT f.query_id, name, CASE WHEN h.query_id IS NULL THEN 1.0 ELSE score END AS score, CASE WHEN h.query_id IS NULL THEN 'graph' ELSE 'hybrid' END AS strategy FROM fused f LEFT JOIN (SELECT DISTINCT query_id FROM vs) h USING (query_id)) SELECT query_id, name, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank, strategy FROM p QUALIFY rank <= 10")
def srch5_strategy(spark, d):
    """Documents beyond the vectors fall back to keywords."""
    return K.search_or_keyword(*_lists(spark, d)).withColumn("score", F.round("score", 6))


# Documents.
@plan("""WITH w AS (SELECT doc_id, string_split_regex(text, '\\s+') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, floor((len(w) - 533) / 483.0)::INT + 1) + 1)) AS k FROM w)
SELECT doc_id, k AS chunk_index, md5(array_to_string(w[k * 483 + 1 : k * 483 + 533], ' ')) AS content, ceil(len(w[k * 483 + 1 : k * 483 + 533]) * 0.75)::INT AS token_count FROM c WHERE k * 483 < len(w)""")
def txt1_word_chunks(spark, d):
    return D.word_chunks(table(spark, d, "documents")).withColumn("content", F.md5("content"))


@plan()
def txt2_sentence_chunks(spark, d):
    """A page for each 3000 characters."""
    docs = table(spark, d, "documents").withColumn("pages", F.ceil(F.length("text") / 3000))
    c = SE.sentence_chunks(docs, pages="pages")
    return c.select("doc_id", "chunk_index", F.md5("content").alias("content"), "start", "end", "page", SE.chunk_kind(F.col("content")).alias("kind"))


# The n-th capitalised word of a text where it occurs first; regexp_extract_all lists them in order.
_CAPS = "regexp_extract_all(text, '\\b[A-Z][a-zA-Z]{2,}\\b')"


@plan(f"""WITH w AS (SELECT DISTINCT doc_id, text, {_CAPS} AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, text, w, min(i) AS i FROM (SELECT doc_id, text, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w) WHERE length(w) < 50 GROUP BY doc_id, text, w),
k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS n FROM u)
SELECT DISTINCT doc_id, 'entity_' || lower(w) AS target, 0.6 AS confidence FROM k WHERE n <= 50""")
def txt5_mentions(spark, d):
    return D.mentions(table(spark, d, "documents").where("text is not null")).distinct()


_TERMS = "terms AS (SELECT item_id AS instance_id, lower(split_part(text, ' ', 2)) AS term, item_id % 2 = 0 AS is_primary FROM benchmark WHERE regexp_matches(split_part(text, ' ', 2), '^[A-Za-z]+$'))"


@plan(f"""WITH {_TERMS}, w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE text IS NOT NULL)
SELECT doc_id, instance_id, term, CASE WHEN is_primary THEN 1.0 ELSE 0.95 END AS confidence FROM w JOIN terms USING (term)""")
def jn11_terms(spark, d):
    word = F.split_part("text", F.lit(" "), F.lit(2))
    t = table(spark, d, "benchmark").where(word.rlike("^[A-Za-z]+$")).select(F.col("item_id").alias("instance_id"), F.lower(word).alias("term"), (F.col("item_id") % 2 == 0).alias("is_primary"))
    return D.term_hits(table(spark, d, "documents"), t)


@plan("WITH p AS (SELECT DISTINCT replace(p_type, ' ', '/') AS path FROM part), x AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM p, range(1, 6) r(i) WHERE i <= len(string_split(path, '/'))) SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, len(string_split(path, '/')) AS depth FROM x")
def txt12_category_tree(spark, d):
    return D.category_tree(table(spark, d, "part").select(F.regexp_replace("p_type", " ", "/").alias("path")).distinct(), "path")


_CATEGORY = " ".join(f"WHEN regexp_matches(n, '{'|'.join(keys)}') THEN '{label}'" for label, keys in D.CATEGORIES)


@plan(f"SELECT p_partkey, CASE {_CATEGORY} ELSE 'General Purpose' END AS category FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS n FROM part)")
def txt13_category(spark, d):
    return table(spark, d, "part").select("p_partkey", D.product_category(F.concat_ws(" ", "p_name", "p_type")).alias("category"))


@plan("SELECT p_partkey, p_name AS uses FROM part")
def txt14_labelled(spark, d):
    t = F.concat(F.lit("Ingredients: water\nUses: "), "p_name", F.lit("\nSafety: none"))
    return table(spark, d, "part").select("p_partkey", F.array_join(D.labelled_lines(t, "Uses"), "|").alias("uses"))


@plan("SELECT p_partkey, greatest(0, least(100, 100 - 15 * (p_size % 4) + 2 * (p_size % 3)) - 5 * (p_size % 4)) AS score FROM part")
def txt15_score(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", Q.product_score(s % 4, s % 3, s % 4).alias("score"))


@plan("SELECT count(*) FILTER (WHERE p_size % 4 = 0) AS valid, count(*) FILTER (WHERE p_size % 4 > 0) AS invalid, sum(p_size % 4) AS errors, round(avg(greatest(0, least(100, 100 - 15 * (p_size % 4) + 2 * (p_size % 3)) - 5 * (p_size % 4))), 6) AS mean_score FROM part")
def agg16_products(spark, d):
    s = F.col("p_size")
    p = table(spark, d, "part").select((s % 4).alias("e"), Q.product_score(s % 4, s % 3, s % 4).alias("q"))
    return p.agg(F.count_if(F.col("e") == 0).alias("valid"), F.count_if(F.col("e") > 0).alias("invalid"), F.sum("e").alias("errors"), F.round(F.avg("q"), 6).alias("mean_score"))


@plan("""WITH k AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS term FROM benchmark), w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\b[A-Z][a-zA-Z]{2,}\\b'))) AS term FROM documents)
SELECT term, count(*) AS n FROM w WHERE term NOT IN (SELECT term FROM k) GROUP BY term""")
def txt16_discoveries(spark, d):
    known = table(spark, d, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("term"))
    return D.discoveries(table(spark, d, "documents"), known).select("term", "n")


# Checks, votes and matching.
_FIELDS = ["headliner", "title", "venue_name", "event_date", "city"]
_CHECKS = f"checks AS (SELECT user_id % 40 AS entity_id, [{', '.join(repr(f) for f in _FIELDS)}][event_id % 5 + 1] AS field, event_type AS original, value / 1000.0 AS confidence, ['match', 'match', 'partial', 'mismatch', 'unverified', 'match', 'match'][event_id % 7 + 1] AS status FROM events WHERE user_id % 3 > 0 OR event_id % 7 <> 3)"
_WEIGHT = "CASE field WHEN 'headliner' THEN 0.2 WHEN 'title' THEN 0.1 WHEN 'venue_name' THEN 0.15 WHEN 'event_date' THEN 0.1 ELSE 0.05 END"
_SCORES = f"""{_CHECKS}, g AS (SELECT entity_id, sum({_WEIGHT} * CASE WHEN status = 'mismatch' THEN greatest(0, confidence - 0.3) ELSE confidence END) FILTER (WHERE status <> 'unverified') AS a, sum({_WEIGHT}) FILTER (WHERE status <> 'unverified') AS b,
 count(*) FILTER (WHERE status = 'match') AS m, count(*) FILTER (WHERE status = 'partial') AS p, count(*) FILTER (WHERE status = 'mismatch') AS x, count(*) FILTER (WHERE status = 'unverified') AS u, count(*) AS t FROM checks GROUP BY entity_id),
scores AS (SELECT entity_id, CASE WHEN b > 0 THEN floor(a / b * 100 + 0.5)::INT ELSE 0 END AS score, CASE WHEN x > 0 THEN 'mismatch' WHEN p > m THEN 'warning' WHEN u = t THEN 'unverified' WHEN m > 0 THEN 'validated' ELSE 'warning' END AS status FROM g)"""


def _checks(spark, d):
    e = table(spark, d, "events").where("user_id % 3 > 0 or event_id % 7 != 3")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    return e.select((F.col("user_id") % 40).alias("entity_id"), pick(_FIELDS, F.col("event_id") % 5).alias("field"), F.col("event_type").alias("original"), (F.col("value") / 1000.0).alias("confidence"), pick(["match", "match", "partial", "mismatch", "unverified", "match", "match"], F.col("event_id") % 7).alias("status"))


@plan(f"WITH {_SCORES} SELECT entity_id, score, status FROM scores")
def agg8_scores(spark, d):
    return Q.overall(_checks(spark, d))


@plan(f"WITH {_SCORES} SELECT entity_id, status FROM scores")
def agg9_status(spark, d):
    return Q.overall(_checks(spark, d)).select("entity_id", "status")


@plan(f"WITH {_SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'mismatch') AS mismatch, count(*) FILTER (WHERE status = 'unverified') AS unverified, floor(avg(score) + 0.5)::INT AS mean_score, count(*) FILTER (WHERE score >= 90) AS high, count(*) FILTER (WHERE score >= 70 AND score < 90) AS medium, count(*) FILTER (WHERE score >= 50 AND score < 70) AS low, count(*) FILTER (WHERE score < 50) AS very_low FROM scores")
def agg7_batch(spark, d):
    return Q.batch_statistics(Q.overall(_checks(spark, d)))


@plan(f"WITH {_CHECKS}, b AS (SELECT DISTINCT entity_id, field, original FROM checks WHERE status = 'mismatch'), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY original, entity_id) AS r FROM b) SELECT field, count(*) AS n, string_agg(original, '|' ORDER BY original) FILTER (WHERE r <= 3) AS examples FROM r GROUP BY field ORDER BY n DESC, field LIMIT 5")
def agg10_top_issues(spark, d):
    return Q.top_issues(_checks(spark, d))


@plan(f"WITH {_SCORES}, s AS (SELECT count(*) AS t, count(*) FILTER (WHERE status = 'mismatch') AS x, count(*) FILTER (WHERE status = 'unverified') AS u, count(*) FILTER (WHERE status = 'warning') AS w, floor(avg(score) + 0.5) AS m FROM scores) SELECT array_to_string(list_filter([CASE WHEN x / t > 0.3 THEN 'review mismatches' END, CASE WHEN u / t > 0.5 THEN 'add sources' END, CASE WHEN m < 70 THEN 'raise data quality' END, CASE WHEN w / t > 0.2 THEN 'check partial matches' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM s")
def agg11_recommendations(spark, d):
    return Q.recommendations(Q.batch_statistics(Q.overall(_checks(spark, d))))


@plan(f"WITH {_SCORES} SELECT entity_id % 4 AS kind, status, count(*) AS n, round(avg(score), 6) AS mean_score FROM scores GROUP BY ROLLUP (kind, status)")
def agg12_report(spark, d):
    s = Q.overall(_checks(spark, d)).withColumn("kind", F.col("entity_id") % 4)
    return s.rollup("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@plan("""WITH v AS (SELECT user_id AS subject, 'type' AS field, event_type AS value, value / 1000.0 AS confidence FROM events), g AS (SELECT subject, field, value, count(*) AS n, sum(confidence) AS t FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, field ORDER BY n DESC, t DESC, value) AS r, sum(n) OVER (PARTITION BY subject, field) AS a, count(*) OVER (PARTITION BY subject, field) AS kinds FROM g)
SELECT subject, field, CASE WHEN n / a >= 0.25 THEN value END AS value, round(t / n * n / a, 8) AS confidence, kinds > 1 AS conflict FROM r WHERE r = 1""")
def con1_categorical(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.lit("type").alias("field"), F.col("event_type").alias("value"), (F.col("value") / 1000.0).alias("confidence"))
    return Q.consensus_categorical(v, 0.25).withColumn("confidence", F.round("confidence", 8))


_VALUES = "v AS (SELECT user_id AS subject, 'venue' AS field, event_type AS value, value / 1000.0 AS confidence FROM events)"


@plan(f"""WITH {_VALUES}, g AS (SELECT subject, field, count(DISTINCT value) AS kinds, arg_max(value, (confidence, value)) AS bv, max(confidence) AS bc, arg_max(value, (length(value), confidence, value)) AS lv, arg_max(confidence, (length(value), confidence, value)) AS lc FROM v GROUP BY ALL)
SELECT subject, field, CASE WHEN kinds > 1 AND lc >= 0.3 THEN lv ELSE bv END AS value, round(CASE WHEN kinds = 1 THEN bc WHEN lc >= 0.3 THEN lc * 0.8 ELSE bc * 0.7 END, 8) AS confidence, kinds > 1 AS conflict FROM g""")
def con1_values(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.lit("venue").alias("field"), F.col("event_type").alias("value"), (F.col("value") / 1000.0).alias("confidence"))
    return Q.consensus_value(v).withColumn("confidence", F.round("confidence", 8))


_ALIKE = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT a.name, b.name AS candidate, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS score FROM n a JOIN n b ON a.name <> b.name {on})"


@plan(f"{_ALIKE.format(on='')} SELECT name, candidate, round(score, 8) AS score, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS rank FROM s QUALIFY rank <= 4")
def jn12_fuzzy(spark, d):
    """Each name's four most similar others, whatever words they share and however unlike they are."""
    p = table(spark, d, "part").select("p_name")
    return M.match_names(p.withColumnRenamed("p_name", "name"), p.withColumnRenamed("p_name", "candidate")).withColumn("score", F.round("score", 8))


@plan(f"{_ALIKE.format(on='AND a.name[1:2] = b.name[1:2]')} SELECT name, candidate, round(score, 8) AS score, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS rank FROM s QUALIFY rank <= 4")
def udf3_similarity(spark, d):
    """A similarity of the user's own, over candidates of the user's own keys: here, the first two letters."""
    p = table(spark, d, "part").select("p_name")
    own = lambda a, b: F.when(a != b, T.levenshtein_similarity(a, b))
    best = Q.fuzzy_best(p.withColumnRenamed("p_name", "name"), p.withColumnRenamed("p_name", "candidate"), own, lambda c: F.array(F.substring(c, 1, 2)), 4)
    return best.where("name != candidate").withColumn("score", F.round("score", 8))


@plan("SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT contains(c_name, '0') THEN 'name' END], lambda x: x IS NOT NULL), ',') AS broken FROM customer")
def udf1_rules(spark, d):
    Q.register_rule("customers", "balance", lambda df: df["c_acctbal"] >= 0)
    Q.register_rule("customers", "name", lambda df: F.contains(df["c_name"], F.lit("0")))
    return Q.apply_rules(table(spark, d, "customer"), "customers").select("c_custkey", F.array_join("broken", ",").alias("broken"))
