"""The review of terms: counts, decisions, replays and earlier versions."""

import pytest

from lakeweave.sources.review_queue import ReviewQueue

WORDS = [("a", " Foam ", "x"), ("a", "foam", "x"), ("a", "FOAM", "y" * 300), ("a", "foam", "y" * 250), ("a", "grit", None), ("b", "foam", "x"), ("a", None, "x"), ("a", " ", "x"), (None, "foam", "x")]
OCC, DEC = "entity_type string, term string, context string", "entity_type string, term string, decision string"


@pytest.fixture
def queue(spark, tmp_path):
    return ReviewQueue(spark, str(tmp_path))


def state(q, upto=None):
    return {(r.entity_type, r.term): (r.n, r.n_contexts, r.first_seen, r.status, r.reviewed_at) for r in q.queue(upto).collect()}


def test_counts_contexts_and_replay(spark, queue):
    occ = spark.createDataFrame(WORDS, OCC)
    queue.add(occ, 1, 10)
    want = {("a", "foam"): (4, 2, 10, "pending", None), ("a", "grit"): (1, 0, 10, "pending", None), ("b", "foam"): (1, 1, 10, "pending", None)}
    assert state(queue) == want
    queue.add(occ, 1, 10)
    assert state(queue) == want
    queue.add(spark.createDataFrame([("a", "foam", "x"), ("a", "wax", "z")], OCC), 2, 20)
    assert state(queue)["a", "foam"] == (5, 2, 10, "pending", None) and state(queue)["a", "wax"] == (1, 1, 20, "pending", None)
    assert state(queue, 1) == want


def test_decisions(spark, queue):
    queue.add(spark.createDataFrame(WORDS, OCC), 1, 10)
    made = spark.createDataFrame([("a", "Foam", "approve", "Foam Level!", ["Suds"], "Foam"), ("a", "grit", "reject", None, None, None), ("b", "nix", "approve", None, None, None), ("b", "foam", "maybe", None, None, None)], DEC + ", primary_term string, synonyms array<string>, display_name string")
    assert set(map(tuple, queue.decide(made, 2, 20).collect())) == {("a", "foam", "approve"), ("a", "grit", "reject"), ("b", "nix", "unknown"), ("b", "foam", "unknown")}
    assert {k: v[3:] for k, v in state(queue).items()} == {("a", "foam"): ("approved", 20), ("a", "grit"): ("rejected", 20), ("b", "foam"): ("pending", None)}
    assert [(r.id, r.primary_term, r.synonyms, r.display_name, r.category, r.synced) for r in queue.instances().collect()] == [("foam_level", "Foam Level!", ["Suds"], "Foam", "unknown", False)]
    # Approved terms and their synonyms are known now; rejected ones still count.
    queue.add(spark.createDataFrame([("a", t, "x") for t in ("foam", "suds", "foam level!", "grit", "new")], OCC), 3, 30)
    assert state(queue)["a", "grit"][0] == 2 and state(queue)["a", "foam"][0] == 4 and ("a", "suds") not in state(queue) and ("a", "new") in state(queue)
    # The last decision counts: the instance goes, and the term is queued again.
    queue.decide(spark.createDataFrame([("a", "foam", "reject")], DEC), 4, 40)
    assert queue.instances().count() == 0 and state(queue)["a", "foam"][3:] == ("rejected", 40) and state(queue, 3)["a", "foam"][3:] == ("approved", 20)


def test_graph_rows_and_sync(spark, queue):
    queue.add(spark.createDataFrame(WORDS, OCC), 1, 10)
    queue.decide(spark.createDataFrame([("a", "foam", "approve"), ("a", "foam", "reject"), ("b", "foam", "approve")], DEC), 2, 20)
    kinds = spark.createDataFrame([("a", "surface_", "Surface", "Surface"), ("b", None, None, None)], "entity_type string, prefix string, graph_type string, label string")
    assert [tuple(r) for r in queue.graph_rows(kinds).collect()] == [("surface_foam", "Surface", ["Surface: foam", "Category: unknown", "Synonyms: "])]
    queue.mark_synced(3)
    queue.mark_synced(3)
    assert queue.graph_rows(kinds).count() == 0 and queue.graph_rows(kinds, 2).count() == 1
    assert all(r.synced for r in queue.instances().collect())


def test_empty(spark, queue):
    assert state(queue) == {} and queue.instances().count() == 0
    queue.add(spark.createDataFrame([], OCC), 1, 10)
    assert state(queue) == {} and queue.decide(spark.createDataFrame([], DEC), 2, 20).count() == 0
