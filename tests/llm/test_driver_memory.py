"""pipeline: what the near-copy stage leaves with the driver."""

from tessella.llm import near_dup


def test_few_edges_are_solved_without_rounds(spark):
    """A chain of 300 edges is one task's work, not rounds of plans; the rounds give the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "few edges")
    got = {tuple(r) for r in near_dup._components(edges).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("few-edges"))
    sc.setJobGroup("other", "other")
    assert got == {(i, 0) for i in range(301)} | {(1000, 1000), (2000, 1000)}
    assert jobs <= 12
    assert got == {tuple(r) for r in near_dup._components(edges, limit=10).collect()}


def test_no_edges(spark):
    assert near_dup._components(spark.createDataFrame([], "a long, b long")).isEmpty()
