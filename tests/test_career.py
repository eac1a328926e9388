"""Career analytics on made tables."""

from quillspark.operators import career


def test_vectors_are_matched_without_being_sent(spark):
    """Vectors and what is made of them may look small to the planner (a column of ids is); they must not be broadcast."""
    profile = spark.createDataFrame([(r, a, float(x)) for r, xs in (("b", (1, 2, 5)), ("a", (1, 2, 5)), ("c", (5, 2, 1))) for a, x in zip("xyz", xs)], "role string, axis string, proficiency double")
    made = [(1, (1, 2, 4)), (2, (5, 3, 1)), (3, (2, 2, 2))]
    vectors = spark.createDataFrame([(i, a, float(x)) for i, xs in made for a, x in zip("xyz", xs)] + [(4, "w", 1.0), (None, "x", 1.0)], "id long, axis string, value double")
    found = career.matched(profile, vectors)
    got = {r.id: (r.role, r.is_flat) for r in found.collect()}
    assert got == {1: ("a", False), 2: ("c", False), 3: ("a", True)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # read once at most, as what is joined with the vectors again may be sent
    assert plan.count("Scan ExistingRDD[id#") <= 1, plan
