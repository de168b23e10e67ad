"""Hand-computable neighbourhood, selection and revision facts."""
import pytest
from pyspark.sql import functions as F

from cellweave.functions.geometry import polygon_problem
from cellweave.operators import filters, neighbourhood as N, revisions as R

# The small published examples whose results these tests state.
CELLS = "cell_id string, x double, y double, label string, included boolean, region string"
LINE = [("source", 0.0, 0.0, "T cell", True, ""), ("near-target", 1.0, 0.0, "Myeloid", True, ""), ("near-other", 2.0, 0.0, "Stromal", True, ""),
        ("far-target", 20.0, 0.0, "Myeloid", True, ""), ("far-other", 30.0, 0.0, "Stromal", True, "")]
OVERLAY = "revision_id string, cell_id string, label string, included boolean, region string"


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame(LINE, CELLS)


def compare(spark, line, overlay, scopes=("whole_slice",), roi=None, tau=0.2, radius=1.1):
    overlays = spark.createDataFrame(overlay, OVERLAY)
    states = N.revision_states(line, overlays, [None, "r1"])
    evaluated = N.edge_weighted(N.neighbour_grid(states, 2, [radius], "T cell", "Myeloid", scopes=scopes, roi=roi), tau)
    return {(r["state"], r["scope"]): r for r in evaluated.collect()}, N.compare_states(evaluated).collect()


def test_relabelling_the_only_neighbour_flips_the_result(spark, line):
    rows, (delta,) = compare(spark, line, [("r1", "near-target", "Stromal", None, None)])
    before, after = rows[0, "whole_slice"], rows[1, "whole_slice"]
    assert (before["observed_fraction"], before["null_fraction"], before["excess_over_abundance"]) == (1.0, 0.5, 0.5)
    assert before["directed_source_edges"] == 1 and after["excess_over_abundance"] == -0.25
    assert delta["effect_delta"] == -0.75 and delta["status"] == "changed"


def test_region_only_edit_is_stable(spark, line):
    _, (delta,) = compare(spark, line, [("r1", "source", None, None, "moved")])
    assert delta["status"] == "stable" and delta["effect_delta"] == 0


def test_scopes_change_nodes_and_null(spark, line):
    roi = line.filter("cell_id in ('source', 'near-target')")
    rows, _ = compare(spark, line, [("r1", "source", None, None, "x")], scopes=N.SCOPES, roi=roi)
    assert (rows[0, "roi_induced"]["node_count"], rows[0, "roi_induced"]["null_fraction"], rows[0, "roi_induced"]["excess_over_abundance"]) == (2, 1.0, 0.0)
    assert (rows[0, "whole_slice"]["node_count"], rows[0, "whole_slice"]["excess_over_abundance"]) == (5, 0.5)


def test_missing_target_is_indeterminate_not_negative(spark, line):
    rows, (delta,) = compare(spark, line, [("r1", c, "Stromal", None, None) for c in ("near-target", "far-target")])
    assert rows[1, "whole_slice"]["reason"] == "target_label_absent_from_neighbor_universe"
    assert rows[1, "whole_slice"]["classification"] == "inconclusive" and delta["status"] == "indeterminate" and delta["effect_delta"] is None


def test_radius_is_inclusive_and_coincident_cells_are_neighbours(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0, "T cell", True, ""), ("b", 0.0, 0.0, "Myeloid", True, ""), ("c", 3.0, 4.0, "Myeloid", True, ""),
                                   ("d", 3.0, 4.0001, "Myeloid", True, "")], CELLS)
    states = N.revision_states(cells, spark.createDataFrame([], OVERLAY), [None])
    row = N.edge_weighted(N.neighbour_grid(states, 1, [5.0], "T cell", "Myeloid"), 0.1).first()
    assert row["directed_source_edges"] == 2 and row["target_edges"] == 2


def test_two_weightings_and_isolated_sources(spark):
    spots = [("s1", 0, "T"), ("b1", 1, "B"), ("o1", 2, "O"), ("o2", 3, "O"), ("s2", 10, "T"), ("b2", 11, "B"), ("isolated", 30, "T")]
    cells = spark.createDataFrame([(c, float(x), 0.0, l, True, "") for c, x, l in spots], CELLS)
    states = N.revision_states(cells, spark.createDataFrame([], OVERLAY), [None])
    grid = N.neighbour_grid(states, 1, [3.0], "T", "B", background="selection", background_members=cells.filter("label <> 'T'"))
    rows = {r["method"]: r for r in N.dual_weighted(grid, 0.1).collect()}
    assert rows["edge_weighted"]["observed_fraction"] == pytest.approx(2 / 4)
    assert rows["source_equal_weighted"]["observed_fraction"] == pytest.approx((1 / 3 + 1) / 2)
    assert rows["edge_weighted"]["isolated_sources"] == 1 and rows["edge_weighted"]["null_fraction"] == pytest.approx(2 / 4)
    assert {r["status"] for r in rows.values()} == {"computed"}


def test_polygon_includes_its_boundary(line):
    found = filters.select_polygon(line, [(-1, -1), (2, -1), (2, 1), (-1, 1)])
    assert sorted(r["cell_id"] for r in found.collect()) == ["near-other", "near-target", "source"]


@pytest.mark.parametrize("ring, problem", [
    ([(0, 0), (2, 2), (2, 0), (0, 1)], "self_intersection"), ([(0, 0), (1, 0), (2, 0)], "zero_area"), ([(0, 0), (1, 0)], "needs_3_to_1000_distinct_vertices"),
    ([(1e9, 1e9), (1e9 + 1, 1e9), (1e9 + 1, 1e9 + 1), (1e9, 1e9)], None), ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], "self_intersection")])
def test_polygon_rules(ring, problem):
    assert polygon_problem(ring) == problem


def test_revision_cycle(spark, line):
    overlays = spark.createDataFrame([("r1", "source", "B cell", None, None)], OVERLAY)
    at_r1 = R.materialise(line, overlays, "r1")
    assert at_r1.filter("label = 'B cell'").count() == 1
    delta = R.propose(at_r1, line.filter("x < 2"), {"label": "B cell", "included": False})
    rows = {r["cell_id"]: r for r in delta.collect()}
    assert set(rows) == {"source", "near-target"} and rows["source"]["label_after"] is None and rows["source"]["included_after"] is False
    r2 = R.apply_delta(overlays, "r1", delta, "r2")
    grown = overlays.unionByName(r2)
    state = {r["cell_id"]: (r["label"], r["included"]) for r in R.materialise(line, grown, "r2").collect()}
    assert state["source"] == ("B cell", False) and state["near-target"] == ("B cell", False) and state["far-other"] == ("Stromal", True)
    back = grown.unionByName(R.revert(grown, "r1", "r3"))
    assert R.table_mismatch(R.materialise(line, back, "r3"), at_r1, ["cell_id"]).count() == 0
    assert R.overlay_violations(line, back, {"r2": "r1", "r3": "r2"}, {"r2": delta}, {"r3": "r1"}).count() == 0
    counts = R.diff_counts(line, R.materialise(line, grown, "r2"), line.filter("x < 1")).first()
    assert (counts["label_changes"], counts["exclusion_changes"], counts["selected_label_changes"], counts["changed_cell_count"]) == (2, 2, 1, 2)


def test_variants_restart_from_the_baseline(spark, line):
    members = spark.createDataFrame([("relabel", "near-target"), ("exclude", "source")], "variant string, cell_id string")
    states = N.variant_states(line, members, {"relabel": {"label": "Stromal"}, "exclude": {"included": False}})
    rows = {r["state"]: r for r in N.edge_weighted(N.neighbour_grid(states, 3, [1.1], "T cell", "Myeloid"), 0.2).collect()}
    assert rows[1]["excess_over_abundance"] == -0.25
    assert rows[2]["reason"] == "source_label_absent_from_included_selection"
    changes = {r["variant"]: r["actual_changed_count"] for r in N.variant_changes(states, ["relabel", "exclude"], None).collect()}
    assert changes == {"relabel": 1, "exclude": 1}


def test_hot_position_is_counted_exactly(spark):
    """A third of all rows on one position: pairs are folded, the sums stay exact."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("cell_id"), F.when(F.col("id") < 1000, 0.0).otherwise(F.col("id") % 50 * 1.0).alias("x"),
                                    F.when(F.col("id") < 1000, 0.0).otherwise(F.floor(F.col("id") / 50) * 1.0).alias("y"),
                                    F.when(F.col("id") % 2 == 0, "T").otherwise("M").alias("label"), F.lit(True).alias("included"), F.lit("").alias("region"))
    states = N.revision_states(rows, spark.createDataFrame([], OVERLAY), [None])
    got = N.edge_weighted(N.neighbour_grid(states, 1, [2.0], "T", "M"), 0.1).first()
    import numpy as np
    p = rows.toPandas()
    xy = p[["x", "y"]].to_numpy()
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= 4
    np.fill_diagonal(near, False)
    t, m = (p["label"] == "T").to_numpy(), (p["label"] == "M").to_numpy()
    assert got["directed_source_edges"] == near[t].sum() and got["target_edges"] == near[t][:, m].sum()
