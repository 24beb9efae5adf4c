"""Checks of records: each order as a show of its customer, with right, odd and missing values in all fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phases as P
from ..operators import pipelines as PL
from ..operators import quality as Q
from ..operators import search as S
from ..operators import validators as V
from .registry import plan, table

YEAR = 2000


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


#: The records' columns, in words that Spark and DuckDB share; city_k and state_k are drawn from the lists of known ones.
_VENUE = "CASE k % 7 WHEN 0 THEN concat(seg, ' Hall') WHEN 1 THEN concat('The ', lower(seg), ' House') WHEN 2 THEN long_day WHEN 3 THEN cast(y AS {s}) WHEN 4 THEN seg WHEN 5 THEN substr(seg, 1, 2) ELSE priority END"
_CITY = "CASE k % 5 WHEN 0 THEN nation WHEN 1 THEN substr(nation, 1, 2) WHEN 2 THEN city_k WHEN 3 THEN concat(nation, '1') END"
_STATE = "CASE k % 6 WHEN 0 THEN substr(nation, 1, 2) WHEN 1 THEN lower(state_k) WHEN 2 THEN seg WHEN 3 THEN upper(city_k) WHEN 4 THEN ' ' ELSE priority END"
_DATE = "CASE k % 8 WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 WHEN 3 THEN concat('31 February ', cast(y AS {s})) WHEN 4 THEN d4 WHEN 5 THEN 'someday' WHEN 6 THEN d6 END"
_YEAR = "CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN 1900 + k % 50 WHEN 2 THEN 2030 WHEN 3 THEN y + 1 ELSE y END"
_DECADE = "CASE k % 4 WHEN 0 THEN concat(cast(y - y % 10 AS {s}), 's') WHEN 1 THEN 'the 1980s' WHEN 3 THEN '90''s' END"
_DOOR = "CASE k % 6 WHEN 0 THEN '19:00' WHEN 1 THEN '7 pm' WHEN 2 THEN '25:00' WHEN 3 THEN 'doors at 9' WHEN 4 THEN '12 am' ELSE '' END"
_SHOW = "CASE k % 5 WHEN 0 THEN '20:00' WHEN 1 THEN '8:30 PM' WHEN 2 THEN '6' WHEN 3 THEN 'show' END"
_COLUMNS = f"{_VENUE} AS venue_name, {_CITY} AS city, {_STATE} AS state, {_DATE} AS event_date, {_YEAR} AS year, {_DECADE} AS decade, {_DOOR} AS door_time, {_SHOW} AS show_time"


def _records(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs)).cast("int"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    o = o.select(
        F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y"), f("MMMM d").alias("long_day"),
        f("d MMMM yyyy").alias("d0"), f("yyyy-MM-dd").alias("d1"), f("EEEE d MMM").alias("d2"), f("MMM yyyy").alias("d4"), f("dd/MM/yy").alias("d6"), pick(V.CITIES).alias("city_k"), pick(list(V.STATES.values())).alias("state_k"),
    )
    return o.selectExpr("k AS o_orderkey", *[c.strip() for c in _split(_COLUMNS.format(s="string").replace("'90''s'", "\"90's\""))])


def _split(columns: str) -> list[str]:
    """The list of 'CASE ... END AS name' expressions."""
    return [c if c.startswith("CASE") else f"CASE {c}" for c in columns.split(", CASE ")]


_REC = f"""src AS (SELECT o_orderkey AS k, c_mktsegment AS seg, n_name AS nation, o_orderpriority AS priority, year(o_orderdate) AS y, strftime(o_orderdate, '%B %-d') AS long_day, strftime(o_orderdate, '%-d %B %Y') AS d0, strftime(o_orderdate, '%Y-%m-%d') AS d1,
 strftime(o_orderdate, '%A %-d %b') AS d2, strftime(o_orderdate, '%b %Y') AS d4, strftime(o_orderdate, '%d/%m/%y') AS d6, {_list(V.CITIES)}[o_orderkey % {len(V.CITIES)} + 1] AS city_k, {_list(V.STATES.values())}[o_orderkey % {len(V.STATES)} + 1] AS state_k
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
rec AS MATERIALIZED (SELECT k AS o_orderkey, {_COLUMNS.format(s='VARCHAR')} FROM src),
codes AS (SELECT unnest({_list([*V.STATES, *V.PROVINCES])}) AS code, unnest({_list([*V.STATES.values(), *V.PROVINCES.values()])}) AS full_name)"""

_WORDS = "|".join(V.VENUE_WORDS)
_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^(the|a|an)\\s+', ''), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_VENUES = f"""vn AS (SELECT o_orderkey, venue_name AS v, regexp_matches(v, '^\\d{{4}}$') OR regexp_matches(v, '^\\d{{1,2}}[/-]\\d{{1,2}}') OR regexp_matches(v, '(?i)^(january|february|march|april|may|june|july|august|september|october|november|december)\\s+\\d') AS odd,
 round(least(1, 0.5 + CASE WHEN regexp_matches(v, '(?i)\\b({_WORDS})\\b') THEN 0.4 ELSE 0 END - CASE WHEN length({_CLEAN('v')}) < 3 THEN 0.2 ELSE 0 END - CASE WHEN upper(v) = v AND length(v) > 3 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(v, '(?i)^the\\s') THEN 0.1 ELSE 0 END), 6)::DOUBLE AS c FROM rec WHERE trim(venue_name) <> ''),
ci AS (SELECT o_orderkey, city, CASE WHEN list_contains({_list(V.CITIES)}, {_CLEAN('city')}) THEN 0.95::DOUBLE WHEN regexp_matches(city, '^[a-zA-Z\\s''.-]+$') AND length(city) >= 2 THEN 0.7 ELSE 0.4 END AS c FROM rec WHERE trim(city) <> ''),
st AS (SELECT o_orderkey, state, coalesce(a.full_name, b.full_name) AS f, CASE WHEN f IS NOT NULL THEN 0.95::DOUBLE WHEN regexp_matches(state, '^[a-zA-Z\\s-]+$') AND length(state) >= 2 THEN 0.6 ELSE 0.3 END AS c
 FROM rec LEFT JOIN codes a ON a.code = upper(trim(state)) LEFT JOIN (SELECT full_name FROM codes LIMIT {len(V.STATES)}) b ON lower(b.full_name) = {_CLEAN('state')} WHERE trim(state) <> ''),
sw AS (SELECT o_orderkey, city, state, upper({_CLEAN('city')}) IN (SELECT code FROM codes) AS a, list_contains({_list(V.CITIES)}, lower(trim(state))) AS b FROM rec WHERE trim(city) <> '' AND trim(state) <> ''),
venue_rows AS (SELECT o_orderkey, 'venue_name' AS field, v AS original, CASE WHEN odd THEN NULL ELSE v END AS validated, CASE WHEN odd THEN 0.3::DOUBLE ELSE c END AS confidence, CASE WHEN odd THEN 'mismatch' WHEN c >= 0.7 THEN 'match' WHEN c >= 0.5 THEN 'partial' ELSE 'unverified' END AS status FROM vn
 UNION ALL SELECT o_orderkey, 'city', city, city, c, CASE WHEN c > 0.9 THEN 'match' WHEN c = 0.7 THEN 'partial' ELSE 'unverified' END FROM ci
 UNION ALL SELECT o_orderkey, 'state', state, coalesce(f, state), c, CASE WHEN c > 0.9 THEN 'match' WHEN c = 0.6 THEN 'partial' ELSE 'unverified' END FROM st
 UNION ALL SELECT o_orderkey, 'city', city, state, 0.3, 'mismatch' FROM sw WHERE a
 UNION ALL SELECT o_orderkey, 'state', state, city, 0.3, 'mismatch' FROM sw WHERE b AND NOT a)"""

_MINUTES = lambda c: f"(CASE WHEN lower(regexp_extract({c}, '(?i)(\\d{{1,2}})(?::(\\d{{2}}))?\\s*(am|pm)?', 3)) = 'pm' AND h_{c} <> 12 THEN h_{c} + 12 WHEN lower(regexp_extract({c}, '(?i)(\\d{{1,2}})(?::(\\d{{2}}))?\\s*(am|pm)?', 3)) = 'am' AND h_{c} = 12 THEN 0 ELSE h_{c} END * 60 + coalesce(TRY_CAST(regexp_extract({c}, '(\\d{{1,2}})(?::(\\d{{2}}))?', 2) AS INT), 0))"
_TIME = lambda c: f"SELECT o_orderkey, '{c}' AS field, {c} AS original, CASE WHEN confidence > 0.5 THEN {c} END AS validated, confidence, CASE confidence WHEN 0.9 THEN 'match' WHEN 0.7 THEN 'partial' ELSE 'unverified' END AS status FROM (SELECT *, CASE WHEN regexp_matches(lower(trim({c})), '^([01]?\\d|2[0-3])(:[0-5]\\d)?\\s*(am|pm)?$') THEN 0.9::DOUBLE WHEN regexp_matches(lower({c}), 'doors|show') THEN 0.7 ELSE 0.4 END AS confidence FROM rec WHERE trim({c}) <> '')"
_MONTH = "CASE " + " ".join(f"WHEN contains(lower(d), '{m}') THEN {i}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + " END"
_DATES = f"""dt AS (SELECT *, event_date AS d, TRY_CAST(regexp_extract(d, '\\b((19|20)\\d{{2}})\\b', 1) AS INT) AS yy, {_MONTH} AS mm, TRY_CAST(regexp_extract(d, '\\b([1-9]|[12]\\d|3[01])(st|nd|rd|th)?\\b', 1) AS INT) AS dd, regexp_matches(lower(d), 'sun|mon|tue|wed|thu|fri|sat') AS wd FROM rec),
ds AS (SELECT *, coalesce(dd > CASE WHEN mm = 2 THEN 29 WHEN mm IN (4, 6, 9, 11) THEN 30 WHEN mm > 0 THEN 31 END, FALSE) AS bad, round(greatest(0, 0.3 + CASE WHEN yy > 0 THEN 0.25 ELSE 0 END + CASE WHEN mm > 0 THEN 0.25 ELSE 0 END + CASE WHEN dd > 0 THEN 0.15 ELSE 0 END + CASE WHEN wd THEN 0.05 ELSE 0 END - CASE WHEN yy < 1950 OR yy > {YEAR + 2} THEN 0.2 ELSE 0 END), 6)::DOUBLE AS c FROM dt),
tm AS (SELECT o_orderkey, door_time, show_time, TRY_CAST(regexp_extract(door_time, '(\\d{{1,2}})', 1) AS INT) AS h_door_time, TRY_CAST(regexp_extract(show_time, '(\\d{{1,2}})', 1) AS INT) AS h_show_time FROM rec),
date_rows AS (SELECT o_orderkey, 'event_date' AS field, d AS original, CASE WHEN NOT bad THEN d END AS validated, CASE WHEN bad THEN 0.3::DOUBLE ELSE c END AS confidence, CASE WHEN bad THEN 'mismatch' WHEN c >= 0.7 THEN 'match' WHEN c >= 0.5 THEN 'partial' ELSE 'unverified' END AS status FROM ds WHERE d IS NOT NULL
 UNION ALL SELECT o_orderkey, 'year', year::VARCHAR, CASE WHEN year < 1950 OR year > {YEAR + 2} THEN NULL ELSE coalesce(yy, year)::VARCHAR END, CASE WHEN year < 1950 OR year > {YEAR + 2} THEN 0.3 WHEN yy <> year THEN 0.4 ELSE 0.9 END, CASE WHEN year < 1950 OR year > {YEAR + 2} OR coalesce(yy <> year, FALSE) THEN 'mismatch' ELSE 'match' END FROM ds WHERE year IS NOT NULL
 UNION ALL SELECT o_orderkey, 'decade', decade, e, CASE WHEN x THEN 0.95 ELSE 0.3 END, CASE WHEN x THEN 'match' ELSE 'mismatch' END FROM (SELECT *, (year // 10 * 10)::VARCHAR || 's' AS e, regexp_replace(decade, '[^0-9sS]', '', 'g') = e AS x FROM rec WHERE decade IS NOT NULL AND year IS NOT NULL)
 UNION ALL {_TIME('door_time')} UNION ALL {_TIME('show_time')}
 UNION ALL SELECT o_orderkey, 'door_time', door_time, NULL, 0.4, 'mismatch' FROM tm WHERE {_MINUTES('door_time')} > {_MINUTES('show_time')})"""


@plan(f"WITH {_REC}, {_VENUES} SELECT * FROM venue_rows")
def dq3_venues(spark, d):
    return V.venue_checks(_records(spark, d), "o_orderkey").drop("message")


@plan(f"WITH {_REC}, {_DATES} SELECT * FROM date_rows")
def dq4_dates(spark, d):
    return V.date_checks(_records(spark, d), "o_orderkey", this_year=YEAR).drop("message")


_WEIGHT = "CASE " + " ".join(f"WHEN field = '{f}' THEN {w}" for f, w in Q.WEIGHTS.items()) + " ELSE 0.05 END"


@plan(f"""WITH {_REC}, {_VENUES}, {_DATES}, al AS (SELECT *, {_WEIGHT} AS w, CASE WHEN status = 'mismatch' THEN greatest(0, confidence - 0.3) ELSE confidence END AS v FROM (SELECT * FROM venue_rows UNION ALL SELECT * FROM date_rows)),
g AS (SELECT o_orderkey, sum(w * v) FILTER (WHERE status <> 'unverified') AS a, sum(w) FILTER (WHERE status <> 'unverified') AS b, count(*) FILTER (WHERE status = 'match') AS m, count(*) FILTER (WHERE status = 'partial') AS p, count(*) FILTER (WHERE status = 'mismatch') AS x, count(*) FILTER (WHERE status = 'unverified') AS u, count(*) AS t FROM al GROUP BY o_orderkey)
SELECT o_orderkey AS entity_id, CASE WHEN b > 0 THEN floor(round(a / b * 100, 6) + 0.5)::INT ELSE 0 END AS score, CASE WHEN x > 0 THEN 'mismatch' WHEN p > m THEN 'warning' WHEN u = t THEN 'unverified' WHEN m > 0 THEN 'validated' ELSE 'warning' END AS status FROM g""")
def dq8_check_all(spark, d):
    return PL.check_records(_records(spark, d), "o_orderkey", YEAR)


# Types by the words of whole documents and the types of near ones; types and confidences are dealt by id.
_TYPES = list(P.TYPE_WORDS)
_GIVEN = [*_TYPES, "Rock Concert", "movie night", "release", "none such"]
_HITS = {t: " + ".join(f"contains(x, '{w}')::INT" for w in ws) or "0" for t, ws in P.TYPE_WORDS.items()}
_EVIDENCE = f"""g AS (SELECT doc_id, lower(coalesce(text, '')) AS x, {_list(_GIVEN)}[doc_id % {len(_GIVEN)} + 1] AS raw, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 120) / 100 * CASE WHEN doc_id % 5 = 0 THEN 100 ELSE 1 END END::DOUBLE AS given FROM documents),
t AS (SELECT *, CASE raw WHEN 'Rock Concert' THEN 'concert' WHEN 'movie night' THEN 'film' WHEN 'release' THEN 'album' WHEN 'none such' THEN 'unknown' ELSE raw END AS type, coalesce(CASE WHEN given > 1 THEN given / 100 ELSE given END, 0.5) AS c, {', '.join(f'{h} AS n_{t}' for t, h in _HITS.items())} FROM g),
o AS (SELECT *, CASE type {' '.join(f"WHEN '{t}' THEN n_{t}" for t in _TYPES)} END AS own, {' + '.join(f'n_{t}' for t in _TYPES)} AS al, CASE type {' '.join(f"WHEN '{t}' THEN {len(ws)}" for t, ws in P.TYPE_WORDS.items())} END AS size FROM t),
b AS (SELECT *, CASE WHEN size = 0 THEN 0.5 ELSE greatest(0, own / size - least((al - own) * 0.05, 0.3)) END AS pattern, c * 0.7 + pattern * 0.3 AS blended FROM o),
n AS (SELECT q, type FROM (SELECT a.vec_id AS q, z.vec_id AS v FROM embeddings a JOIN embeddings z ON a.vec_id % 50 = 0 AND a.vec_id <> z.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], z.embedding::DOUBLE[]) DESC, z.vec_id) <= 5) JOIN t ON doc_id = v GROUP BY ALL)"""


def _evidence(spark, d):
    docs, given = table(spark, d, "documents"), F.get(F.array(*map(F.lit, _GIVEN)), (F.col("doc_id") % len(_GIVEN)).cast("int"))
    conf = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 120) / 100 * F.when(F.col("doc_id") % 5 == 0, 100).otherwise(1))
    r = docs.select("doc_id", "text", given.alias("given"), conf.alias("conf"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = S.knn(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), v, 5)
    near = near.join(r.select(F.col("doc_id").alias("id"), F.col("given").alias("type")), "id").select(F.col("query_id").alias("doc_id"), "type")
    return P.type_evidence(r, "doc_id", "text", "given", "conf", near)


@plan(f"WITH {_EVIDENCE} SELECT doc_id, b.type, round(pattern, 8) AS pattern, round(blended, 8) AS blended, round(CASE WHEN n.q IS NULL THEN blended ELSE least(1, blended + 0.1) END, 8) AS confidence FROM b LEFT JOIN n ON q = doc_id AND n.type = b.type")
def dq6_types(spark, d):
    r = lambda c: F.round(c, 8)
    return _evidence(spark, d).drop("ready").withColumns({c: r(c) for c in ("pattern", "blended", "confidence")})


@plan(f"WITH {_EVIDENCE} SELECT doc_id, type, round(blended, 8) AS confidence, TRUE AS is_primary FROM b UNION ALL SELECT doc_id, u.t, round(blended * u.w, 8), FALSE FROM b, (VALUES ('album', 0.9), ('concert', 0.85)) u(t, w) WHERE type = 'hybrid'")
def dq6_inferred(spark, d):
    return P.inferred_types(_evidence(spark, d), "doc_id").withColumn("confidence", F.round("confidence", 8))


#: Of each order: confidences of its parts, some missing.
_PARTS = {
    "headliner": "CASE WHEN k % 4 > 0 THEN k % 100 / 100.0 END", "external": "CASE WHEN k % 3 = 0 THEN k END", "venue": "CASE WHEN k % 5 > 0 THEN k % 90 / 100.0 END", "known": "CASE WHEN k % 7 = 0 THEN k END", "validated": "CASE WHEN k % 5 = 1 THEN venue_name END",
    "dated": "CASE WHEN k % 8 < 7 THEN k % 80 / 100.0 END", "parsed": "k % 8 < 3", "artist_valid": "CASE WHEN k % 6 > 1 THEN k % 6 > 2 END", "venue_valid": "CASE WHEN k % 9 > 1 THEN k % 9 > 3 END", "type_score": "k % 101 / 100.0",
}
_PARTS_SQL = ", ".join(f"({x.replace('k % ', 'o_orderkey % ').replace('THEN k ', 'THEN o_orderkey ')}) AS {n}" for n, x in _PARTS.items())


@plan(f"""WITH {_REC}, {_VENUES}, {_DATES}, p AS (SELECT *, {_list(_TYPES)}[o_orderkey % {len(_TYPES)} + 1] AS type, {_PARTS_SQL} FROM rec),
s AS (SELECT o_orderkey, type_score::DOUBLE AS t, least(1, CASE WHEN headliner IS NOT NULL THEN headliner * 0.6 + CASE WHEN external IS NULL THEN 0 ELSE 0.1 END WHEN type IN ('exhibition', 'promo') THEN 0.3 ELSE 0 END + 0.3 * CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE (headliner_or + 0.4) / 2 END)::DOUBLE AS a,
 CASE WHEN venue IS NOT NULL THEN least(1, venue + CASE WHEN city <> '' THEN 0.1 ELSE 0 END + CASE WHEN known IS NULL THEN 0 ELSE 0.15 END + CASE WHEN validated <> '' THEN 0.1 ELSE 0 END) WHEN type IN ('album', 'promo', 'film') THEN 0.6 ELSE 0 END::DOUBLE AS v,
 greatest(0, least(1, coalesce(dated, CASE WHEN type IN ('promo', 'unknown') THEN 0.5 ELSE 0 END) + CASE WHEN door_time <> '' OR show_time <> '' THEN 0.1 ELSE 0 END - CASE WHEN NOT artist_valid THEN 0.15 ELSE 0 END - CASE WHEN NOT venue_valid THEN 0.1 ELSE 0 END + CASE WHEN parsed THEN 0.1 ELSE 0 END))::DOUBLE AS e FROM (SELECT *, coalesce(headliner, 0.2) AS headliner_or FROM p)),
w AS (SELECT o_orderkey, field FROM venue_rows WHERE status IN ('partial', 'mismatch') UNION SELECT o_orderkey, field FROM date_rows WHERE status IN ('partial', 'mismatch') UNION SELECT o_orderkey, 'type_phase' FROM s WHERE round(t, 8) < 0.7 UNION SELECT o_orderkey, 'artist_phase' FROM s WHERE round(a, 8) < 0.6 UNION SELECT o_orderkey, 'venue_phase' FROM s WHERE round(v, 8) < 0.6 UNION SELECT o_orderkey, 'event_phase' FROM s WHERE round(e, 8) < 0.5),
f AS (SELECT o_orderkey, string_agg(field, '|' ORDER BY field) AS fields FROM w GROUP BY ALL)
SELECT o_orderkey, round(a, 8) AS artist, round(v, 8) AS venue, round(e, 8) AS event, round(coalesce(list_avg(list_filter([t, round(a, 8), round(v, 8), round(e, 8)], lambda x: x > 0)), 0), 6) AS overall, coalesce(fields, '') AS fields FROM s LEFT JOIN f USING (o_orderkey)""")
def dq7_phases(spark, d):
    rec = _records(spark, d).withColumn("k", F.col("o_orderkey"))
    p = rec.withColumn("type", F.get(F.array(*map(F.lit, _TYPES)), (F.col("k") % len(_TYPES)).cast("int"))).selectExpr("*", *[f"{x} AS {n}" for n, x in _PARTS.items()])
    p = p.withColumns({c: F.col(c).cast("double") for c in ("headliner", "venue", "dated", "type_score")})
    c = {n: F.col(n) for n in p.columns}
    supports = F.when(c["k"] % 2 == 0, F.array().cast("array<double>")).otherwise(F.array(F.coalesce(c["headliner"], F.lit(0.2)), F.lit(0.4)))
    artist = P.artist_confidence(c["type"], c["headliner"], c["external"], supports)
    venue = P.venue_confidence(c["type"], c["venue"], c["city"], c["known"], c["validated"])
    event = P.event_confidence(c["type"], c["dated"], c["parsed"], c["door_time"], c["show_time"], c["artist_valid"], c["venue_valid"])
    scored = p.select("o_orderkey", c["type_score"].alias("type"), *[F.round(x, 8).alias(n) for n, x in (("artist", artist), ("venue", venue), ("event", event))])
    out = P.review(scored, V.record_checks(rec.drop("k"), "o_orderkey", YEAR), "o_orderkey")
    return scored.join(out, "o_orderkey").select("o_orderkey", "artist", "venue", "event", F.round("overall", 6).alias("overall"), F.array_join("fields", "|").alias("fields"))


_CLAIMS = """h AS (SELECT o_custkey AS name, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_orderkey, o_custkey AS name, CASE WHEN o_orderkey % 13 > 0 THEN year(o_orderdate) + o_orderkey % 37 - 12 END AS year FROM orders WHERE o_orderkey % 2 = 1)"""


def _active(spark, d, span):
    """Odd orders' years, moved by up to 24, against the customer's even orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("name"), F.year("o_orderdate").alias("year"))
    moved = F.when(F.col("o_orderkey") % 13 > 0, F.col("year") + F.col("o_orderkey") % 37 - 12)
    return P.activity(o.where("o_orderkey % 2 = 1").withColumn("year", moved), o.where("o_orderkey % 2 = 0").select("name", "year"), span)


@plan(f"WITH {_CLAIMS} SELECT o_orderkey, name, year, first_year, last_year, coalesce(year BETWEEN first_year - 5 AND last_year + 10, TRUE) AS valid FROM c LEFT JOIN h USING (name)")
def jn17_artist_active(spark, d):
    return _active(spark, d, P.ARTIST_SPAN)


@plan(f"WITH {_CLAIMS} SELECT o_orderkey, name, year, first_year, last_year, coalesce(year BETWEEN first_year AND last_year + 20, TRUE) AS valid FROM c LEFT JOIN h USING (name)")
def jn17_venue_open(spark, d):
    return _active(spark, d, P.VENUE_SPAN)


_VOTES = "SELECT user_id * 20 + event_id % 20 AS subject, CASE WHEN event_id % 3 = 0 THEN 'genre' ELSE 'poster_type' END AS field, event_type AS value, value / 1000.0 AS confidence FROM events"


@plan(f"""WITH v AS ({_VOTES}), g AS (SELECT subject, field, value, count(*) AS n, sum(confidence) AS t FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, field ORDER BY n DESC, t DESC, value) AS r, sum(n) OVER (PARTITION BY subject, field) AS a, count(*) OVER (PARTITION BY subject, field) AS kinds FROM g)
SELECT subject, field, CASE WHEN n / a >= 0.5 AND NOT (a = 1 AND field = 'poster_type') THEN value END AS value, CASE WHEN a = 1 AND field = 'poster_type' THEN 0 ELSE round(t / n * n / a, 8) END AS confidence, kinds > 1 AS conflict FROM r WHERE r = 1""")
def con1_strict(spark, d):
    v = table(spark, d, "events").selectExpr("user_id * 20 + event_id % 20 AS subject", "CASE WHEN event_id % 3 = 0 THEN 'genre' ELSE 'poster_type' END AS field", "event_type AS value", "value / 1000.0 AS confidence")
    return Q.consensus_categorical(v, strict=("poster_type",)).withColumn("confidence", F.round("confidence", 8))
