"""Two rounds of review of the capitalised words of all documents, even ids first, a kind of term for each language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources.review_queue import ReviewQueue
from ..sources.scratch import folder
from .registry import plan, table


def _reviewed(spark, d) -> ReviewQueue:
    """After the first half every third count is approved and every third rejected, and approvals go to the graph; after the second
    half all that is still pending is decided by its count too."""
    q = ReviewQueue(spark, folder(spark))
    docs = table(spark, d, "documents").where("text is not null")
    words = docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("entity_type"), F.explode(F.regexp_extract_all("text", F.lit(D.CAPITALISED), F.lit(0))).alias("term"), "text")
    words = words.select("doc_id", "entity_type", "term", F.col("text").alias("context"))
    verdict = F.when(F.col("n") % 3 == 0, "approve").otherwise("reject")
    q.add(words.where("doc_id % 2 = 0"), 1, 1000)
    first = q.queue(1).where("n % 3 < 2").select("entity_type", "term", verdict.alias("decision"), F.concat(F.initcap("term"), F.lit(" One")).alias("primary_term"), F.array(F.concat("term", F.lit("s"))).alias("synonyms"))
    q.decide(first, 2, 2000)
    q.mark_synced(3)
    q.add(words.where("doc_id % 2 = 1"), 4, 4000)
    q.decide(q.queue(4).where("status = 'pending' and n % 5 < 4").select("entity_type", "term", verdict.alias("decision")), 5, 5000)
    return q


_STEPS = """o AS MATERIALIZED (SELECT doc_id, entity_type, lower(w) AS term, c FROM (SELECT doc_id, coalesce(lang, 'none') AS entity_type, unnest(regexp_extract_all(text, '\\b[A-Z][a-zA-Z]{2,}\\b')) AS w, text[1:200] AS c FROM documents)),
b1 AS (SELECT entity_type, term, count(*) AS n FROM o WHERE doc_id % 2 = 0 GROUP BY ALL),
d2 AS (SELECT entity_type, term, CASE WHEN n % 3 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM b1 WHERE n % 3 < 2),
known AS (SELECT entity_type, unnest([term, term || ' one', term || 's']) AS term FROM d2 WHERE status = 'approved'),
kept AS MATERIALIZED (SELECT * FROM o WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM o WHERE doc_id % 2 = 1 AND (entity_type, term) NOT IN (SELECT (entity_type, term) FROM known)),
q4 AS (SELECT entity_type, term, count(*) AS n, count(DISTINCT c) AS n_contexts, CASE WHEN min(doc_id % 2) = 0 THEN 1000 ELSE 4000 END AS first_seen FROM kept GROUP BY ALL),
d5 AS (SELECT entity_type, term, CASE WHEN n % 3 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM q4 WHERE (entity_type, term) NOT IN (SELECT (entity_type, term) FROM d2) AND n % 5 < 4)"""


@plan(f"""WITH {_STEPS} SELECT entity_type, term, n::BIGINT AS n, n_contexts, first_seen::BIGINT AS first_seen, coalesce(d2.status, d5.status, 'pending') AS status, CASE WHEN d2.status IS NOT NULL THEN 2000 WHEN d5.status IS NOT NULL THEN 5000 END::BIGINT AS reviewed_at
FROM q4 LEFT JOIN d2 USING (entity_type, term) LEFT JOIN d5 USING (entity_type, term)""")
def txt16_queue(spark, d):
    return _reviewed(spark, d).queue()


@plan(f"""WITH {_STEPS} SELECT entity_type || '_' || term AS name, 'Term' AS entity_type, upper(entity_type) || ': ' || term || '|Category: unknown|Synonyms: ' AS observations FROM d5 WHERE status = 'approved' AND entity_type <> 'none'""")
def txt16_graph_rows(spark, d):
    """The approvals of the second round; those of the first are in the graph."""
    kinds = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("entity_type")).distinct()
    kinds = kinds.select("entity_type", F.concat("entity_type", F.lit("_")).alias("prefix"), F.when(F.col("entity_type") != "none", "Term").alias("graph_type"), F.upper("entity_type").alias("label"))
    return _reviewed(spark, d).graph_rows(kinds).withColumn("observations", F.array_join("observations", "|"))
