"""Queries over the corpus tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import parquet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(parquet(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op8_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import imatch
    from .neighbours import with_next
    from .tables import cut

    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = imatch.Lexicon(cut(imatch.lexicon(docs)))
    rows = with_next(docs, "doc_id", ["text", "fingerprint"], tie="text", derive=lambda rows: imatch.fingerprint(rows, held))
    rows = rows.withColumn("edited", imatch.edited(F.col("text"), F.col("next_text")))
    rows = imatch.fingerprint(rows, held, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _imatch_sql(text: str) -> tuple[str, str]:
    """SQL of the lexicon, and of whole hash and parts of a column of table `texts`; constants as in imatch.py."""
    from .imatch import DRAWS, GAPS, IDF_HIGH, IDF_LOW, SHARES

    terms = f"list_filter(list_distinct(string_split_regex(lower({text}), '{GAPS}')), lambda w: w <> '')"
    kept = lambda r, k: f"list_filter(k, lambda w: ('0x' || substr(sha256(w), {4 * r + 1}, 4))::BIGINT < {1 << (16 - 2 * k)})"
    parts = ", ".join(f"array_to_string({kept(r, k)}, ' ')" for r in range(DRAWS) for k in range(1, SHARES + 1))
    return f"""
lex AS MATERIALIZED (
  SELECT term FROM (SELECT unnest(list_filter(list_distinct(string_split_regex(lower(text), '{GAPS}')), lambda w: w <> '')) AS term FROM texts) GROUP BY term
  HAVING count(*) BETWEEN (SELECT ceil(count(*) * exp(-{IDF_HIGH})) FROM texts) AND (SELECT floor(count(*) * exp(-{IDF_LOW})) FROM texts)),
""", f"""
  SELECT rn, md5(CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE t END) AS h,
         list_transform([{parts}], lambda p: CASE WHEN p = '' THEN '-' ELSE substr(md5(p), 1, 8) END) AS p
  FROM (SELECT rn, any_value(t) AS t, coalesce(list_sort(list(term) FILTER (term IN (SELECT term FROM lex))), []::VARCHAR[]) AS k
        FROM (SELECT rn, {text} AS t, unnest(CASE WHEN len({terms}) = 0 THEN [NULL] ELSE {terms} END) AS term FROM texts) GROUP BY rn)
"""


def _op9_sql() -> str:
    lex, own = _imatch_sql("text")
    _, changed = _imatch_sql("edited")

    def like(a: str, b: str) -> str:
        some = f"len(list_filter(list_zip({a}.p, {b}.p), lambda q: q[1] <> '-' OR q[2] <> '-'))"
        return f"CASE WHEN {a}.h = {b}.h THEN 1.0 WHEN {some} = 0 THEN 0.0 ELSE len(list_filter(list_zip({a}.p, {b}.p), lambda q: q[1] = q[2] AND q[1] <> '-'))::DOUBLE / {some} END"

    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS rn FROM documents),
nexts AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rn), first(text) OVER (ORDER BY rn)) AS nt, coalesce(lead(rn) OVER (ORDER BY rn), 1) AS nrn FROM base),
texts AS MATERIALIZED (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nt, 1, length(text) // 2) AS edited FROM nexts),
{lex}
own AS MATERIALIZED ({own}), changed AS MATERIALIZED ({changed})
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, o.h || ' ' || array_to_string(o.p, ' ') AS fingerprint,
       c.h || ' ' || array_to_string(c.p, ' ') AS edited_fingerprint, {like("o", "c")} AS near_edited, {like("o", "n")} AS near_next
FROM texts t JOIN own o ON o.rn = t.rn JOIN changed c ON c.rn = t.rn JOIN own n ON n.rn = t.nrn
"""


ORACLE["op9_imatch"] = _op9_sql()


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import Options, near_duplicates

    return near_duplicates(parquet(spark, sf_dir, "documents").select("doc_id", "text"), Options(shingle=3, percent=85))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import default_path
    from .packing import pack, pieces

    made = pieces(parquet(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(docs, parquet(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


#: For the queries alone; users pass a secret of their own.
DEMO_KEY = "a published key: links values, hides nothing"


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return pseudonymise(docs, DEMO_KEY, count_column="n_replaced")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True, equal_chars=1).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("text_sha256"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs.where(~held), language.default_path())
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = pieces.decode(pieces.encode(parquet(spark, sf_dir, "documents").select("doc_id", "text"), model, differing="n_differing"), model)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"), "n_differing")


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import copies

    return copies(parquet(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op12_exact_dedup"] = r"""
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
best AS (SELECT body, count(*) AS group_size, max(n) AS n FROM rows GROUP BY body),
ids AS (SELECT body, min(doc_id) AS keep_id FROM rows JOIN best USING (body, n) GROUP BY body)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, doc_id IS NULL AND keep_id IS NULL) AND rows.n = best.n AS kept, sha256(body) AS text_sha256
FROM rows JOIN best USING (body) JOIN ids USING (body)
"""


@query
def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(parquet(spark, sf_dir, "documents").select("doc_id", "text"), parquet(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE["op13_bag_search"] = r"""
WITH words AS (
  SELECT doc_id, rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
bags AS MATERIALIZED (SELECT doc_id, rn, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT rn, sum(tf)::BIGINT AS n FROM bags GROUP BY rn),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM lengths),
held AS (SELECT term, count(*) AS df FROM bags GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, rn, sum(floor(1000 * ln((2.0 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN bags USING (term) JOIN lengths USING (rn), totals GROUP BY item_id, doc_id, rn)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt, trie

    return trie(rebuilt(parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: crc32 of the decimal id as a fold over its characters, eight shifts after each.
ORACLE["op11_prefix_trie"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos,
         {'role': role, 'text': text} AS t FROM rows),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id),
heads AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
           flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 4 AS h FROM own),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS MATERIALIZED (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS k FROM (SELECT *, unnest(generate_series(0, len(ts))) AS d FROM whole)),
nodes AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, row_number() OVER () AS id,
         coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM steps GROUP BY k, d),
linked AS (SELECT c.*, p.conv_id AS parent_conv_id, p.id AS parent FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.k = c.k[1:c.d - 1] AND c.d > 0),
children AS (SELECT parent AS id, count(*) AS n_children FROM linked GROUP BY parent),
full_nodes AS MATERIALIZED (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (id)),
below AS (
  SELECT a.id, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, d)) AS up FROM full_nodes) b JOIN nodes a ON a.d = b.up AND a.k = b.k[1:b.up] GROUP BY a.id)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM full_nodes JOIN below USING (id)
"""
