"""Blocked entity resolution."""

import pytest

from siltstone.operators import resolve

SCHEMA = "embedding array<float>, entity_type string"
V1, V2 = [float(i % 7 - 3) for i in range(64)], [float(3 - i % 7) for i in range(64)]


def tables(spark):
    m = spark.createDataFrame([(V1, "person", 1, "Jon Smith", []), (None, "person", 2, "Jon Smith", None)], SCHEMA + ", mention_id long, text string, cooc array<long>")
    e = spark.createDataFrame([(V1, "person", 7, "Dr Jon Smith", None), (V2, "person", 8, "Mx Jon Smith", None), (None, "person", 9, "Sir Jon Smith", None)], SCHEMA + ", entity_id long, canonical_name string, aliases array<string>")
    return m, e


def test_a_mention_that_only_its_embedding_can_find(spark):
    got = {r.mention_id: r for r in resolve.resolve(*tables(spark)).collect()}
    assert (got[1].entity_id, got[1].action) == (7, "review") and abs(got[1].score - (0.4 + 0.25 * 0.75 + 0.15)) < 1e-9
    assert (got[2].entity_id, got[2].action, got[2].score) == (None, "create", 0)
    assert tuple(resolve.blocking_savings(*tables(spark)).first()) == (6, 1)


def test_planes_of_another_length_are_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        resolve.candidates(*tables(spark), planes=[[1.0, 2.0]]).collect()
