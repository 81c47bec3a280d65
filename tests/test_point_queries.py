"""Point queries as they are registered: how they are joined, and the very rows of their SQL."""

import duckdb
import pytest

from stipple.plans import registry

ENTRIES = registry.registry()


def test_perimeters_are_rounded_as_in_sql(spark, tmp_path):
    """In images 0 and 27 of sf0.1 the fourth place depends on the SQL's first rounding, to six places, and on how it rounds a tie."""
    spark.read.parquet("/root/testdata/sf0.1/part.parquet").filter("floor(p_partkey / 400) in (0, 27)").write.parquet(f"{tmp_path}/part.parquet")
    run, sql = ENTRIES["hull_perimeter"]
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = {(r["image_id"], r["comp_id"]): r["perimeter"] for r in run(spark, str(tmp_path)).collect()}
    assert got and got == {(i, c): p for i, c, p in con.execute(f"select image_id, comp_id, perimeter from ({sql})").fetchall()}


@pytest.mark.parametrize("name", ["hull_perimeter", "annulus_edges", "component_size_filter", "hull_simplify", "point_components", "spacing"])
def test_points_do_not_pass_the_driver(spark, sf, name):
    """In the plan that ran, with those of the tables that it keeps."""
    out = ENTRIES[name][0](spark, sf)
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan
