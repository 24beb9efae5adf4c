"""Filters, pages, joins, collection merges and reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Paging defaults: rows of a page, and most that a page may ask for.
PAGE, MOST = 10, 1000


def page(df: DataFrame, order: list, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page in a total order; a page is a feature of reports, not a cut of the data."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST)))


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """total, current_page, total_pages, has_more (exact)."""
    limit = max(1, min(limit, MOST))
    n = df.agg(F.count("*").alias("total"))
    return n.select("total", F.lit(offset // limit + 1).alias("current_page"), F.ceil(F.col("total") / limit).cast("int").alias("total_pages"), (F.col("total") > offset + limit).alias("has_more"))


def keyword(entities: DataFrame, term: str, types: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Entities whose name, type or any observation contains the term, taken literally."""
    fold = (lambda c: c) if case_sensitive else F.lower
    q = F.lit(term if case_sensitive else term.lower())
    hit = F.contains(fold(F.col("name")), q) | F.contains(fold(F.col("entity_type")), q) | F.exists("observations", lambda o: F.contains(fold(o), q))
    return entities.where(hit & F.col("entity_type").isin(types) if types else hit)


def predicate(column: str, op: str, value) -> Column:
    c = F.col(column)
    return {"eq": c == value, "ne": c != value, "gt": c > value, "lt": c < value}[op] if op != "contains" else F.contains(c.cast("string"), F.lit(str(value)))


def metadata_equals(df: DataFrame, json_column: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON has all these keys with these values."""
    return df.where(reduce(lambda a, b: a & b, [F.get_json_object(json_column, f"$.{k}") == v for k, v in wanted.items()]))


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[f for f in fields if f in df.columns])


#: Lengths of grams. A text is looked up by grams of the largest of them that it has room for.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def contained(whole: DataFrame, part: DataFrame) -> DataFrame:
    """x, y: distinct non-empty texts of `whole` and `part` (a column each) where x holds y anywhere, equal ones included.

    If x holds y, it holds all grams of y, so each y is looked up by that gram of its own which fewest x have. Grams are two
    thirds of a text at least (up to the largest of SIZES), so texts that differ in a few characters are told apart by most of
    them. What is verified follows rare grams, not all pairs that share a frequent one. Neither side is broadcast."""
    x, y = whole.toDF("x").where("x != ''").distinct(), part.toDF("y").where("y != ''").distinct()
    room = F.coalesce(*[F.when(F.length("y") >= n, n) for n in reversed(SIZES)])
    used = sorted(r[0] for r in y.select(room.alias("n")).distinct().collect())
    grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    have = x.select("x", F.explode(F.array_distinct(F.concat(none, *[grams(F.col("x"), n) for n in used]))).alias("g"))
    want = y.select("y", F.explode(F.array_distinct(F.coalesce(*[F.when(room == n, grams(F.col("y"), n)) for n in used], none))).alias("g"))
    counts = have.groupBy("g").agg(F.count("*").alias("n"))
    rarest = want.join(counts.hint("merge"), "g").groupBy("y").agg(F.min(F.struct("n", "g")).alias("m"))
    return have.join(rarest.select("y", F.col("m.g").alias("g")).hint("merge"), "g").where(F.contains("x", "y")).select("x", "y")


def match_terms(names: DataFrame, terms: DataFrame, prefix: str = "") -> DataFrame:
    """name, term, kind, confidence: exact 1.0, one in the other 0.9, a shared word 0.8. Texts in each other meet on their
    rarest grams; pairs that share a word are results themselves, so that join is as large as its output."""
    n = names.select("name").distinct().withColumn("_n", F.regexp_replace(F.lower(F.regexp_replace("name", f"^{prefix}", "")), "_", " "))
    t = terms.select("term").distinct().withColumn("_t", F.lower("term"))
    a, b = n.select("_n").distinct(), t.select("_t").distinct()
    held = contained(a, b).toDF("_n", "_t").union(contained(b, a).select("y", "x"))
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("g")).where("g != ''")
    shared = words(a, "_n").join(words(b, "_t"), "g").select("_n", "_t")
    pairs = held.union(shared).distinct()
    kind = F.when(F.col("_n") == F.col("_t"), "exact").when(F.contains("_n", "_t") | F.contains("_t", "_n"), "substring").otherwise("partial")
    found = pairs.withColumn("kind", kind).join(n, "_n").join(t, "_t")
    return found.select("name", "term", "kind", F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "substring", 0.9).otherwise(0.8).alias("confidence"))


def audit_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`df` with faults: the names of the rules that a row breaks (a rule that gives null is broken)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("faults", F.array_compact(F.array(*checks)))


def split_known(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of left with a partner, rows without)."""
    return left.join(right, on, "left_semi"), left.join(right, on, "left_anti")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int | None = None) -> DataFrame:
    """The first k rows of each group, with rank; all of them without k."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def nested(parents: DataFrame, links: DataFrame, on: str, item: list[str], order: list, into: str) -> DataFrame:
    """`parents` with an array of their links, best first; a parent without links gets an empty one. A parent's links are
    bounded by the types there are."""
    numbered = links.withColumn("_r", F.row_number().over(W.partitionBy(on, item[0]).orderBy(*order))).where("_r = 1")
    lists = numbered.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*[c for c in item]))).alias(into))
    out = parents.join(lists, on, "left")
    return out.withColumn(into, F.coalesce(into, F.array().cast(out.schema[into].dataType)))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n: counts of each column's values, in one pass (grouping sets)."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(items).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def pick_files(files: DataFrame) -> DataFrame:
    """extension, n, bytes with a total row (null extension), from columns path and length."""
    e = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return e.rollup("extension").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
