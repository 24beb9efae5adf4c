"""Readers and writers: graph JSON, file listings, catalogues, snapshots, embeddings, staging areas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Graph:
    entities: DataFrame
    relations: DataFrame


_LINE = "type string, name string, entityType string, observations array<string>, `from` string, `to` string, relationType string"


def read_graph(spark: SparkSession, path: str, lines: bool = True) -> Graph:
    """A graph from JSON lines tagged entity or relation (bad lines are skipped), or from one document with both lists."""
    if lines:
        rows = spark.read.schema(_LINE).json(path, mode="PERMISSIVE")
        return Graph(rows.where("type = 'entity' and name is not null").select("name", F.col("entityType").alias("entity_type"), "observations"), rows.where("type = 'relation'").select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("relationType").alias("relation_type")))
    schema = "entities array<struct<name: string, entityType: string, observations: array<string>>>, relations array<struct<`from`: string, `to`: string, relationType: string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    e = doc.select(F.explode("entities").alias("x")).select("x.name", F.col("x.entityType").alias("entity_type"), "x.observations")
    return Graph(e, doc.select(F.explode("relations").alias("x")).select(F.col("x.from").alias("src"), F.col("x.to").alias("dst"), F.col("x.relationType").alias("relation_type")))


def write_graph(graph: Graph, path: str) -> None:
    """A full snapshot, as Parquet."""
    graph.entities.write.mode("overwrite").parquet(f"{path}/entities")
    graph.relations.write.mode("overwrite").parquet(f"{path}/relations")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, modified of files; their contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", F.col("modificationTime").alias("modified"))


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """path, hash (first 16 hex digits of sha-256) and how many files share it."""
    h = files.select("path", F.substring(F.sha2(content, 256), 1, 16).alias("hash"))
    return h.join(h.groupBy("hash").agg(F.count("*").alias("copies")), "hash").select("path", "hash", "copies")


def run_inventory(files: DataFrame) -> DataFrame:
    """run_id, kind (FULL or PARTIAL), n_files, n_pdf, bytes, newest first, from paths runs/<run_id>/...."""
    f = files.withColumn("run_id", F.regexp_extract("path", r"runs/([^/]+)/", 1)).where("run_id != ''")
    g = f.groupBy("run_id").agg(F.count("*").alias("n_files"), F.count_if(F.lower("path").endswith(".pdf")).alias("n_pdf"), F.sum("length").alias("bytes"), F.count_if(F.col("path").rlike("/products/")).alias("p"), F.count_if(F.col("path").rlike("/categories/")).alias("c"))
    return g.select("run_id", F.when((F.col("p") > 0) & (F.col("c") > 0), "FULL").otherwise("PARTIAL").alias("kind"), "n_files", "n_pdf", "bytes").orderBy(F.desc("run_id"))


def read_products(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Product JSON, a file (or a line) each; columns with several names are merged, missing lists are empty."""
    schema = "product_name string, name string, product_code string, code string, product_url string, url string, product_categories array<string>, product_skus array<string>, container_sizes array<string>, pds_url string, sds_url string"
    p = spark.read.schema(schema).json(path, multiLine=not lines)
    empty = F.array().cast("array<string>")
    return p.select(F.coalesce("product_name", "name").alias("name"), F.coalesce("product_code", "code").alias("code"), F.coalesce("product_url", "url").alias("url"), F.coalesce("product_categories", empty).alias("categories"), F.coalesce("product_skus", "container_sizes", empty).alias("sizes"), F.col("pds_url").isNotNull().alias("has_pds"), F.col("sds_url").isNotNull().alias("has_sds"))


def term_index(catalogue: DataFrame) -> DataFrame:
    """entity_type, instance_id, term (lower case), is_primary of catalogue rows (entity_type, enabled, instance_id,
    primary_term, synonyms) whose extraction is enabled."""
    both = F.array_union(F.array(F.lower("primary_term")), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s)))
    return catalogue.where("enabled").select("entity_type", "instance_id", F.lower("primary_term").alias("_p"), F.explode(both).alias("term")).select("entity_type", "instance_id", "term", (F.col("term") == F.col("_p")).alias("is_primary"))


def seed_missing(existing: DataFrame, seeds: DataFrame, key: str = "name") -> DataFrame:
    """Seed rows that aren't there yet."""
    return seeds.join(existing.select(key).distinct(), key, "left_anti")


def upsert_vectors(existing: DataFrame, batch: DataFrame, dimension: int) -> DataFrame:
    """The last write of each entity_id, by updated_at, then the batch's; of equal ones in a batch, that of the least hash. Vectors of
    another dimension are rejected."""
    every = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))).where(F.size("embedding") == dimension)
    r = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("updated_at"), F.desc("_new"), F.xxhash64("embedding")))
    return every.withColumn("_r", r).where("_r = 1").drop("_r", "_new")


def delete_vectors(existing: DataFrame, gone: DataFrame) -> DataFrame:
    return existing.join(gone.select("entity_id").distinct(), "entity_id", "left_anti")


def backup(tables: dict[str, DataFrame], path: str, stamp: str) -> DataFrame:
    """Write each table under snapshot=<stamp>/ and a manifest of their row counts, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        out = f"{path}/snapshot={stamp}/{name}"
        df.write.mode("overwrite").parquet(out)
        counts.append((name, spark.read.parquet(out).count()))
    manifest = spark.createDataFrame(counts, "name string, n long")
    manifest.write.mode("overwrite").json(f"{path}/snapshot={stamp}/manifest")
    return manifest


def archive(live: DataFrame, path: str, stamp: str) -> tuple[int, DataFrame]:
    """Append all live rows under archive_ts=<stamp>/: how many there were, and the empty table that takes the live one's place."""
    live.write.mode("append").parquet(f"{path}/archive_ts={stamp}")
    return live.sparkSession.read.parquet(f"{path}/archive_ts={stamp}").count(), live.limit(0)


def move(staging: DataFrame, live: DataFrame, keys: DataFrame, key: str, name: Column) -> tuple[DataFrame, DataFrame]:
    """(staging without, live with) the rows of the given keys, which get an entity_name on the way."""
    k = keys.select(key).distinct()
    moved = staging.join(k, key, "left_semi").withColumn("entity_name", name)
    return staging.join(k, key, "left_anti"), live.unionByName(moved, allowMissingColumns=True)
