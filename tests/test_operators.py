"""Known answers on tiny tables."""

import pytest
from pyspark.sql import functions as F

from lakeweave.functions import text as T
from lakeweave.operators import documents as D
from lakeweave.operators import graph as G
from lakeweave.operators import quality as Q
from lakeweave.operators import search as S
from lakeweave.operators import tables as O
from lakeweave.operators import temporal as TM
from lakeweave.sources import io
from lakeweave.streaming import streams as ST

DATES = [
    ("31/03-95 (released on March 31, 1995)", "31/03/1995"), ("6453", None), ("Sunday 27 January", "27/01"), ("March 3rd, 1999", "03/03/1999"),
    ("5 May 68", "05/05/1968"), ("29/02/1999", None), ("1999-12-31", "31/12/1999"), ("17.10.05", "17/10/2005"), (None, None), ("", None),
]


@pytest.fixture(scope="module")
def triangle(spark):
    e = spark.createDataFrame([(n, "t", []) for n in "ABCD"], "name string, entity_type string, observations array<string>")
    r = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")], "src string, dst string").withColumns({"relation_type": F.lit("x"), "strength": F.lit(1.0)})
    return e, r


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dates(spark):
    df = spark.createDataFrame(DATES, "raw string, want string")
    assert all(r.want == r.got for r in df.select("want", T.normalise_date(F.col("raw")).alias("got")).collect())


def test_date_lists(spark):
    df = spark.createDataFrame([("12-15 May 1999",), ("1-20 May",), ("x",)], "a string")
    got = [r[0] for r in df.select(T.expand_dates(F.col("a"))).collect()]
    assert got == [["12 May 1999", "13 May 1999", "14 May 1999", "15 May 1999"], ["1 May", "20 May"], ["x"]]


def test_similarities(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("martha", "marhta")], "a string, b string")
    got = df.select(T.levenshtein_similarity(F.col("a"), F.col("b")), T.jaro_winkler("a", "b")).collect()
    assert got[0][0] == pytest.approx(0.571429, abs=1e-6) and got[1][1] == pytest.approx(0.961111, abs=1e-6)


def test_clustering_and_influence(triangle):
    e, r = triangle
    assert rows(G.clustering(e, r), "name", "triangles", "possible") == [("A", 1, 1), ("B", 1, 1), ("C", 1, 3), ("D", 0, 0)]
    assert rows(G.influence(e, r), "name", "direct", "indirect", "radius")[0] == ("A", 2, 1, 2)


def test_paths(spark, triangle):
    got = G.simple_paths(triangle[1], spark.createDataFrame([("A", "D")], "s string, t string"), depth=4).orderBy("rank").collect()
    assert [r.path for r in got] == [["A", "C", "D"], ["A", "B", "C", "D"]]


def test_as_of(spark):
    df = spark.createDataFrame([(10, 20)], "valid_from long, valid_to long")
    assert [TM.as_of(df, t).count() for t in (9, 10, 19, 20)] == [0, 1, 1, 0]


def test_decay(spark):
    day = 86_400_000
    df = spark.createDataFrame([(0.8, -30 * day), (0.8, -120 * day), (None, 0)], "confidence double, valid_from long")
    assert [None if r.decayed is None else round(r.decayed, 6) for r in TM.decayed(df, 0).collect()] == [0.4, 0.1, None]


def test_history_is_sound(spark):
    log = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("v", 2, "c")], "k string, at long, value string")
    assert TM.chain_audit(TM.history(log, "k", "at", ["at"], "value"), "k").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 533)), (2, " ".join(["w"] * 1000)), (3, None)], "doc_id long, text string")
    assert rows(D.word_chunks(df), "doc_id", "chunk_index", "token_count") == [(1, 0, 400), (1, 1, 38), (2, 0, 400), (2, 1, 388)]


def test_scores(spark):
    checks = spark.createDataFrame([("e", "headliner", 0.95, "match"), ("e", "venue_name", 0.7, "partial"), ("e", "year", 0.4, "mismatch")], "entity_id string, field string, confidence double, status string")
    assert rows(Q.overall(checks), "score", "status") == [(75, "mismatch")]


def test_scores_and_confidences_side_by_side(spark):
    checks = spark.createDataFrame([("e", "headliner", 0.95, "match")], "entity_id string, field string, confidence double, status string")
    fields = spark.createDataFrame([("e", 0.5, False), ("e", 1.0, True)], "subject string, confidence double, conflict boolean")
    assert (Q.overall(checks).first().score, round(Q.overall_confidence(fields).first().confidence, 6)) == (95, 0.65)


def test_no_module_defines_a_name_twice():
    import ast
    import pathlib

    import lakeweave

    for path in pathlib.Path(lakeweave.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path


def test_consensus(spark):
    v = spark.createDataFrame([("s", "type", "concert", 0.8), ("s", "type", "film", 0.9)], "subject string, field string, value string, confidence double")
    r = Q.consensus_categorical(v).first()
    assert (r.value, round(r.confidence, 6), r.conflict) == ("film", 0.45, True)
    v = spark.createDataFrame([("s", "venue", "Forum", 0.9), ("s", "venue", "The Forum Theatre", 0.5)], "subject string, field string, value string, confidence double")
    r = Q.consensus_value(v).first()
    assert (r.value, round(r.confidence, 6)) == ("The Forum Theatre", 0.4)


def test_fusion(spark):
    one = spark.createDataFrame([(1, "e", 0.8)], "query_id int, name string, score double")
    assert S.search(one, one, "rrf").first().score == pytest.approx(2 / 61)
    assert S.fuse_weighted(one.withColumn("score", F.lit(1.0)), one).first().score == pytest.approx(0.88)


def test_terms(spark):
    n = spark.createDataFrame([("artist_the_beatles",)], "name string")
    assert rows(O.match_terms(n, spark.createDataFrame([("beatles",)], "term string"), "artist_"), "kind", "confidence") == [("substring", 0.9)]


def test_read_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"entity","name":"a","entityType":"t","observations":[]}\nnot json\n{"type":"relation","from":"a","to":"b","relationType":"r"}\n')
    g = io.read_graph(spark, str(tmp_path / "g.json"))
    assert (g.entities.count(), g.relations.count()) == (1, 1)
    (tmp_path / "d.json").write_text('{"entities": [], "relations": []}')
    assert io.read_graph(spark, str(tmp_path / "d.json"), lines=False).entities.count() == 0


def test_backup(spark, tmp_path):
    m = io.backup({"x": spark.range(3).toDF("a")}, str(tmp_path), "1")
    assert rows(m, "name", "n") == [("x", 3)]


def test_ingest_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "text string, t long").selectExpr("text", "timestamp_seconds(t) as at").write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema("text string, at timestamp").parquet(str(src))
        ST.ingest_once(stream, str(out), str(tmp_path / f"c{_}"), "text", "at").awaitTermination(60)
    assert spark.read.parquet(str(out)).count() == 2


def test_streamed_counts_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 10), ("a", 20), ("b", 90_000)], "kind string, t long").selectExpr("kind", "timestamp_seconds(t) as at").write.parquet(str(src))
    q = ST.rolling_counts(spark.readStream.schema("kind string, at timestamp").parquet(str(src)), "at", "kind").writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = ST.rolling_counts(spark.read.parquet(str(src)), "at", "kind")
    assert rows(spark.table("rolled"), "start", "kind", "n") == rows(want, "start", "kind", "n")
