"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix. A url's candidate keys are each domain suffix of its host followed by each prefix of
its path that is as long as some rule's path. The cascade is exact over all candidate keys of the corpus (the key
universe): level 1 encodes the listed keys, level 2 the keys of the universe that level 1 lets through wrongly, level 3
the listed keys that level 2 lets through, and so on until nothing is left over. The first level's rate follows from the
numbers of listed and other keys, so that the levels after it stay about as small as the list. Lookups are array reads, no
join, as long as a level's words fit into the plan (MAX_BITS). The words of a larger level stay a table in the shared
folder, sharded by word number; then the universe's keys are tested level by level, each key's positions against that table,
and urls find their keys among those that the cascade confirms.

Nulls and urls without `://` have empty host and path and match nothing. Repeated rules count once; a key both allowed
and blocked is blocked. Equal lengths can't tie within one host: keys of equal length differ in host length, and the
longer host wins. Rules are a list or a table of action, host and path. Repeated rows are judged alike, very long urls whole,
empty tables and empty rules give no match; other columns stay, those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, drop

#: Largest level that goes out with the plan: 4 MB. Larger ones are tables.
MAX_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, path_lengths: Iterable[int]) -> Column:
    """Longest first; of equal length the one with the longer host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(set(path_lengths))])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.struct((-(F.length(s) + n)).alias("a"), (-F.length(s)).alias("b"), F.concat(s, F.substring(path, 1, n)).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


@dataclass
class Bloom:
    bits: int
    hashes: int
    seed: int
    words: Column | None = None
    #: word, bits: of a level that is too large for the plan.
    table: DataFrame | None = None

    @staticmethod
    def sized(n: int, rate: float, seed: int) -> Bloom:
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        return Bloom(bits, max(1, round(bits / max(n, 1) * math.log(2))), seed)

    def positions(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)])

    def fill(self, keys: DataFrame) -> Bloom:
        """Set the bits of all keys: one row per 64-bit word, whatever the number of keys."""
        at = keys.select(F.explode(self.positions(F.col("key"))).alias("at"))
        word, bit = F.expr("at div 64"), F.expr("shiftleft(1L, cast(at % 64 as int))")
        rows = at.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        if self.bits > MAX_BITS:
            self.table = cut(rows)
            return self
        words = [0] * (self.bits // 64)
        for r in rows.collect():
            words[r["word"]] = r["bits"]
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        return self

    def through(self, keys: DataFrame) -> DataFrame:
        """The keys that pass."""
        if self.table is None:
            return keys.where(self.passes(F.col("key")))
        at = keys.select("key", F.explode(F.array_distinct(self.positions(F.col("key")))).alias("at")).withColumn("word", F.expr("at div 64"))
        hit = F.getbit("bits", F.expr("cast(at % 64 as int)")) == 1
        tested = at.join(self.table, "word", "left").groupBy("key").agg(F.min(F.coalesce(hit, F.lit(False))).alias("all"))
        return tested.where("all").select("key")

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits))
            out = out & (F.getbit(F.element_at(self.words, (F.shiftright(at, 6) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


@dataclass
class Cascade:
    """Exact membership of the universe's keys in the listed keys."""

    levels: list[Bloom] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out

    @property
    def in_plan(self) -> bool:
        return all(level.table is None for level in self.levels)

    def members(self, keys: DataFrame) -> DataFrame:
        """The keys (distinct, of the universe) that are listed: those that an odd number of levels lets through in turn."""
        out, left = None, keys
        for i, level in enumerate(self.levels):
            left = cut(level.through(left))
            if i % 2 == 0:
                # Listed unless the next level lets it through as well.
                out = left if out is None else out.union(left)
            else:
                out = out.join(left, "key", "left_anti")
        return keys.limit(0) if out is None else out

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, first_rate: float | None = None, later_rate: float = 0.5) -> Cascade:
        """`listed` and `universe`: a column key, not null, distinct. first_rate: by default such that the levels are smallest
        together, from the numbers of keys."""
        out, inside, outside, temporary, seed = Cascade(), listed, universe, [], 1
        while n := inside.count():
            if seed == 1:
                first_rate = first_rate or min(0.5, max(1e-9, 0.5**0.5 * n / max(1, universe.count())))
            level = Bloom.sized(n, first_rate if seed == 1 else later_rate, seed)
            out.levels.append(level.fill(inside))
            through = level.through(outside)
            if seed == 1:
                through = through.join(listed, "key", "left_anti")
            through = cut(through)
            temporary.append(through)
            inside, outside, seed = through, inside, seed + 1
        drop(*temporary)
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict. rules: (action, host, path), action allow or block. The longest fitting
    rule decides; where no listed key fits, the cascade says so exactly and the verdict is `default`."""
    spark: SparkSession = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().where("host != ''")
    lengths = {r[0] for r in rules.select(F.length("path")).distinct().collect()} or {1}  # as many as paths have lengths
    with_parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).fillna("", ["host", "path"])
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = cut(with_parts.select(F.explode(keys).alias("key")).distinct())
    listed = {a: rules.where(F.col("action") == a).select(F.concat("host", "path").alias("key")).distinct() for a in ("block", "allow")}
    cascades = {a: Cascade.build(k, universe) for a, k in listed.items()}
    verdict = F.when(F.col("rule").isNull(), default)
    if all(c.in_plan for c in cascades.values()):
        drop(universe)
        member = {a: c.contains for a, c in cascades.items()}
        out = with_parts.withColumn("rule", F.get(F.filter(keys, lambda k: member["block"](k) | member["allow"](k)), F.lit(0)))
        return out.withColumn("verdict", verdict.when(member["block"](F.col("rule")), "block").otherwise("allow"))
    found = [c.members(universe).select("key", F.lit(a).alias("action")) for a, c in cascades.items()]
    found = cut(found[0].union(found[1]).groupBy("key").agg(F.max("action").alias("action")))  # block is the greater word
    drop(universe)
    asked = with_parts.select("host", "path").distinct().withColumn("_lw_keys", keys)
    best = asked.select("host", "path", F.posexplode("_lw_keys").alias("at", "key")).join(found, "key").groupBy("host", "path").agg(F.min(F.struct("at", "key", "action")).alias("_lw_best"))
    out = with_parts.join(best, ["host", "path"], "left").withColumn("rule", F.col("_lw_best.key"))
    return out.withColumn("verdict", verdict.otherwise(F.col("_lw_best.action"))).drop("_lw_best")
