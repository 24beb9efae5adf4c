"""Keyword search against a plain loop, and the fallback to it."""

from lakeweave.operators import keywords as K

NAMES = ["b_1", "a_1", "c_2", None, "d_4", "e_5"]
ENTITIES = [(n, k, o) for n, k, o in zip(NAMES, ["Part", "Steel works", "Part", "Part", None, "Part"], [["Name: steel Bolt", "Red"], ["other"], None, ["steel"], ["red", "BOLT"], ["re", "d"]])]
SCHEMA = "name string, entity_type string, observations array<string>"
QUERIES = [(1, "steel"), (2, "RED"), (3, "bolt"), (4, ""), (5, None), (6, "steel"), (7, "a.*"), (8, "t\u0001r"), (9, "_")]


def plain(limit=None, types=None, fold=str.lower):
    out = set()
    for q, w in QUERIES:
        if not w or "\u0001" in w:
            continue
        hits = sorted({n for n, k, o in ENTITIES if n and (not types or k in types) and any(fold(w) in fold(f) for f in [n, k, *(o or [])] if f is not None)})
        out |= {(q, n) for n in hits[:limit]}
    return out


def found(spark, monkeypatch, blocks=False, **kw):
    if blocks:
        monkeypatch.setattr(K, "KEYWORD_BLOCK", 2)
        monkeypatch.setattr(K, "TEXT_BLOCK", 20)
    e = spark.createDataFrame(ENTITIES + ENTITIES[:2], SCHEMA).repartition(3)
    rows = K.keyword_search(spark.createDataFrame(QUERIES, "query_id int, text string"), e, **kw).collect()
    assert len(rows) == len(set(rows)) and all(r.score == 1.0 for r in rows)
    return {(r.query_id, r.name) for r in rows}


def test_all_matches(spark, monkeypatch):
    assert found(spark, monkeypatch) == plain()


def test_limit_types_case_and_many_blocks(spark, monkeypatch):
    assert found(spark, monkeypatch, True, limit=1) == plain(1)
    assert found(spark, monkeypatch, True, types=["Part"]) == plain(types=["Part"])
    assert found(spark, monkeypatch, case_sensitive=True) == plain(fold=str)


def test_many_hits_of_one_keyword_keep_the_least_names(spark):
    rows = spark.range(3000).selectExpr("concat('n', lpad(id, 5, '0')) name", "'t' entity_type", "array('common') observations")
    got = K.keyword_search(spark.createDataFrame([(1, "common")], "query_id int, text string"), rows, limit=3)
    assert sorted(r.name for r in got.collect()) == ["n00000", "n00001", "n00002"]


def test_empty_tables(spark):
    e, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame(QUERIES, "query_id int, text string")
    assert K.keyword_search(q, e).count() == 0
    assert K.keyword_search(q.limit(0), spark.createDataFrame(ENTITIES, SCHEMA)).count() == 0


def test_fallback_to_keywords(spark):
    schema = "query_id int, name string, score double"
    k, v = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], schema), spark.createDataFrame([(1, "a", 0.5), (1, "c", 0.9)], schema)
    got = {tuple(r) for r in K.search_or_keyword(k, v).collect()}
    assert got == {(1, "a", 0.4 + 0.5 * 0.6, 1, "hybrid"), (1, "c", 0.9 * 0.6, 2, "hybrid"), (2, "b", 1.0, 1, "graph")}
