import pytest

from tessella.session import local_session, tune


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, memory="6g")
    tune(s)
    yield s


@pytest.fixture(scope="session")
def crowd(spark):
    """Every detection of the smallest table in two large images, materialised."""
    from tessella.plans.relations import det
    from tessella.session import cut

    d = det(spark, "/root/testdata/sf0.001").where("category_id <= 2").selectExpr(
        "image_id % 2 AS image_id", "det_id", "x1 * 7 AS x1", "y1 * 31 AS y1", "x1 * 7 + (x2 - x1) AS x2", "y2 + y1 * 30 AS y2", "score",
        "element_type", "grp", "priority",
    )
    return cut(d)
