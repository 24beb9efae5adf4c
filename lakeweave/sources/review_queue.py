"""The review of discovered terms: a versioned queue, decisions on it, and the catalogue instances and graph rows that follow.

The queue is three logs under one folder, a sub-folder a batch: what was seen, what was decided, what went to the graph. Its state
is a fold of the logs up to a batch, so every earlier version can be read, and a batch that runs again replaces its own folder
alone: counts don't grow by a replay. Batches of all three kinds share one ascending number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["entity_type", "term"]
SEEN = "entity_type string, term string, n long, first_seen long, batch int"
CONTEXTS = "entity_type string, term string, context string, batch int"
DECIDED = "entity_type string, term string, decision string, primary_term string, synonyms array<string>, display_name string, category string, reviewed_at long, batch int"
SYNCED = "entity_type string, id string, batch int"
#: Characters of a context that are kept.
CONTEXT = 200


class ReviewQueue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str, schema: str, upto: int | None) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return log if upto is None else log.where(F.col("batch") <= upto)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def add(self, occurrences: DataFrame, batch: int, at: int) -> None:
        """Queue occurrences (entity_type, term, context) of terms, in lower case and trimmed. Terms that were approved before this
        batch, and the synonyms given with them, are known and no longer queued; rejected ones go on being counted. Rows with a
        null or blank term are left out; a null context counts, but is kept as none."""
        o = occurrences.select("entity_type", F.trim(F.lower("term")).alias("term"), F.substring("context", 1, CONTEXT).alias("context")).where("term != '' and entity_type is not null")
        known = self.instances(batch - 1)
        known = known.select("entity_type", F.explode(F.concat(F.array("term", F.trim(F.lower("primary_term"))), F.transform("synonyms", lambda s: F.trim(F.lower(s))))).alias("term")).distinct()
        # A term's occurrences are counted with their contexts first, so that a frequent one meets in one task as a few rows.
        o = o.join(known, KEY, "left_anti").groupBy(*KEY, "context").agg(F.count("*").alias("n"))
        self._write(o.where("context is not null").select(*KEY, "context"), "contexts", batch)
        self._write(o.groupBy(*KEY).agg(F.sum("n").alias("n"), F.lit(at).cast("long").alias("first_seen")), "seen", batch)

    def decide(self, decisions: DataFrame, batch: int, at: int) -> DataFrame:
        """Take decisions (entity_type, term, decision: approve or reject, and optional primary_term, synonyms, display_name,
        category) on queued terms. The outcome rows: entity_type, term, outcome (approve, reject, or unknown for terms that are
        not in the queue and words that are no decision; these change nothing). Of several decisions on a term the last batch
        counts, within a batch approval."""
        d = decisions.withColumn("term", F.trim(F.lower("term")))
        for c, kind in (("primary_term", "string"), ("synonyms", "array<string>"), ("display_name", "string"), ("category", "string")):
            d = d if c in d.columns else d.withColumn(c, F.lit(None).cast(kind))
        queued = self._log("seen", SEEN, batch).select(*KEY).distinct().withColumn("_q", F.lit(True))
        d = d.join(queued, KEY, "left").withColumn("outcome", F.when(F.col("_q") & F.col("decision").isin("approve", "reject"), F.col("decision")).otherwise("unknown"))
        order = F.struct("decision", "primary_term", "display_name", "category", "synonyms")
        kept = d.where("outcome != 'unknown'").groupBy(*KEY).agg(F.min(order).alias("x"))
        self._write(kept.select(*KEY, "x.decision", "x.primary_term", "x.synonyms", "x.display_name", "x.category", F.lit(at).cast("long").alias("reviewed_at")), "decided", batch)
        return d.select(*KEY, "outcome").distinct()

    def _decided(self, upto: int | None) -> DataFrame:
        last = self._log("decided", DECIDED, upto).groupBy(*KEY).agg(F.max_by(F.struct("decision", "primary_term", "synonyms", "display_name", "category", "reviewed_at"), "batch").alias("x"))
        return last.select(*KEY, "x.*")

    def queue(self, upto: int | None = None) -> DataFrame:
        """entity_type, term, n, n_contexts, first_seen, status (pending, approved, rejected), reviewed_at, as of a batch."""
        seen = self._log("seen", SEEN, upto).groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
        said = self.contexts(upto).groupBy(*KEY).agg(F.count("*").alias("n_contexts"))
        out = seen.join(said, KEY, "left").join(self._decided(upto).select(*KEY, "decision", "reviewed_at"), KEY, "left")
        status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("pending")
        return out.select(*KEY, "n", F.coalesce("n_contexts", F.lit(0)).cast("long").alias("n_contexts"), "first_seen", status.alias("status"), "reviewed_at")

    def contexts(self, upto: int | None = None) -> DataFrame:
        """entity_type, term, context: the distinct contexts of each term, a row each, however many."""
        return self._log("contexts", CONTEXTS, upto).select(*KEY, "context").distinct()

    def instances(self, upto: int | None = None) -> DataFrame:
        """entity_type, term, id, primary_term, synonyms, display_name, category, synced of terms whose last decision is approval."""
        a = self._decided(upto).where("decision = 'approve'").withColumn("primary_term", F.coalesce("primary_term", "term"))
        slug = F.regexp_replace(F.regexp_replace(F.lower("primary_term"), r"\s+", "_"), "[^a-z0-9_]", "")
        none = F.array().cast("array<string>")
        a = a.select(*KEY, slug.alias("id"), "primary_term", F.coalesce("synonyms", none).alias("synonyms"), F.coalesce("display_name", "term").alias("display_name"), F.coalesce("category", F.lit("unknown")).alias("category"))
        gone = self._log("synced", SYNCED, upto).select("entity_type", "id").distinct().withColumn("_s", F.lit(True))
        return a.join(gone, ["entity_type", "id"], "left").select(*a.columns, F.coalesce("_s", F.lit(False)).alias("synced"))

    def graph_rows(self, types: DataFrame, upto: int | None = None) -> DataFrame:
        """name, entity_type, observations of instances that are not in the graph yet. types: entity_type, prefix, graph_type,
        label (a row a type); types without a graph_type have no rows. Of instances of one id the least term gives the row."""
        i = self.instances(upto).where("not synced").join(types.where("graph_type is not null"), "entity_type")
        one = i.groupBy("entity_type", "id").agg(F.min_by(F.struct("prefix", "graph_type", "label", "display_name", "category", "synonyms"), "term").alias("x")).select("entity_type", "id", "x.*")
        said = F.array(F.concat_ws(": ", "label", "display_name"), F.concat(F.lit("Category: "), F.col("category")), F.concat(F.lit("Synonyms: "), F.array_join("synonyms", ", ")))
        return one.select(F.concat(F.coalesce("prefix", F.lit("")), F.col("id")).alias("name"), F.col("graph_type").alias("entity_type"), said.alias("observations"))

    def mark_synced(self, batch: int) -> None:
        """Note all instances of earlier batches as part of the graph."""
        self._write(self.instances(batch - 1).where("not synced").select("entity_type", "id").distinct(), "synced", batch)
