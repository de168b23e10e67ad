"""Readers, attributes, quality, proteins, atlas and contracts on small golden inputs."""
import json
import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions import ids, predicates as P
from cellweave.functions.geometry import polygon_contains  # noqa: F401
from cellweave.operators import atlas, expression as E, filters, integration as I, protein as PR, quality, validate as V
from cellweave.sources import registry, sinks, text

ATTR = f"cell_id string, x double, y double, label string, included boolean, region string, attributes {P.ATTRIBUTE_TYPE}"


def num(v):
    return ("num", float(v), None, None)


def test_typed_attribute_comparison(spark):
    values = {"a": num(0), "b": num(2), "c": num(2.0), "d": num(5), "e": ("null", None, None, None), "f": None, "g": ("str", None, "2", None), "h": ("bool", None, None, True)}
    df = spark.createDataFrame([(k, 0.0, 0.0, "L", True, "", {} if v is None else {"qc": v}) for k, v in values.items()], ATTR)
    run = lambda op, value: filters.query_observations(df, attribute=("qc", op, value))
    found = lambda q: sorted(r["cell_id"] for r in filters.matching(q).collect())
    assert found(run("eq", 2)) == ["b", "c"] and found(run("ne", 2)) == ["a", "d"] and found(run("ge", 2)) == ["b", "c", "d"]
    assert found(run("eq", "2")) == ["g"] and found(run("eq", True)) == ["h"]
    assert filters.unavailable_count(run("ne", 2)).first()["attribute_unavailable_count"] == 4
    with pytest.raises(ValueError):
        run("lt", "2")


def test_three_valued_selector(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, "L", True, "", {"q": num(1)}), ("b", 0.0, 0.0, "L", True, "", {}), ("c", 0.0, 0.0, "M", True, "", {})], ATTR)
    counts = spark.createDataFrame([("a", "G", 3.0)], "cell_id string, feature_id string, value double")
    features = spark.createDataFrame([("G", "G")], "feature_id string, symbol string")
    clauses = [{"field": "label", "op": "eq", "value": "L"}, {"field": "attributes.q", "op": "in", "value": [1, "x"]}]
    assert {r["cell_id"]: r["resolution"] for r in filters.resolve_selector(df, clauses, counts, features).collect()} == {"a": "chosen", "b": "unknown"}
    off = [{"field": "counts.H", "op": "ge", "value": 0}]
    assert {r["resolution"] for r in filters.resolve_selector(df, off, counts, features).collect()} == {"unknown"}
    zero = [{"field": "counts.G", "op": "eq", "value": 0}]
    assert sorted(r["cell_id"] for r in filters.resolve_selector(df, zero, counts, features).collect()) == ["b", "c"]
    with pytest.raises(filters.UnmeasuredFeature):
        filters.query_observations(df, counts, features, gene="H")


def test_quality_keeps_absent_null_and_zero_apart(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, "L", True, "", {"cell_area": num(0)}), ("b", 0.0, 0.0, "L", False, "", {"cell_area": ("null", None, None, None)}),
                                ("c", 0.0, 0.0, "L", True, "", {})], ATTR)
    row = quality.numeric_fields(df, ["cell_area"]).first()
    assert (row["valid_count"], row["absent_count"], row["null_count"], row["zero_count"], row["median"]) == (1, 1, 1, 1, 0.0)
    counts = spark.createDataFrame([("a", "g", 2.0), ("a", "h", 3.0), ("c", "g", 1.0)], "cell_id string, feature_id string, value double")
    libs = {r["cell_id"]: r["library"] for r in E.libraries(df, counts).collect()}
    assert libs == {"a": 5.0, "b": 0.0, "c": 1.0}
    features = spark.createDataFrame([("g", "g"), ("h", "h"), ("z", "z")], "feature_id string, symbol string")
    panel = {r["feature_id"]: r for r in E.panel_summary(df, counts, features, ["g", "z", "KDR"]).collect()}
    assert panel["g"]["mean"] == 1.0 and panel["z"]["mean"] == 0 and panel["KDR"]["status"] == "unmeasured" and panel["KDR"]["mean"] is None


def test_paired_protein(spark):
    cells = spark.createDataFrame([(f"c{i}", float(i), 0.0, "L", True, "") for i in range(5)], "cell_id string, x double, y double, label string, included boolean, region string")
    counts = spark.createDataFrame([(f"c{i}", "R", float(i + 1)) for i in range(4)], "cell_id string, feature_id string, value double")
    protein = spark.createDataFrame([(f"c{i}", "P", 2.0 * i) for i in range(4)] + [("c4", "P", None)], "cell_id string, feature_id string, value double")
    row = PR.channel_summary(cells, protein, ["P"]).first()
    assert (row["measured_count"], row["missing_count"], row["zero_count"], row["median_raw"]) == (4, 1, 1, 3.0)
    rho = {r["measure"]: r for r in PR.rna_protein_correlation(PR.rna_protein_pairs(cells, counts, protein, "R", ["P"])).collect()}
    assert rho["raw"]["rho"] == pytest.approx(1) and rho["per_10k"]["status"] == "unknown"  # one gene: per-10k is constant


def test_feature_identity(spark):
    features = spark.createDataFrame([("id1", "A"), ("id2", "A"), ("B", None), ("id4", "B"), ("symbol:odd", "C")], "feature_id string, symbol string")
    asked = spark.createDataFrame([(q,) for q in ("A", "B", "feature_id:B", "symbol:B", "C", "nope")], "query string")
    got = {r["query"]: r for r in filters.resolve_features(features, asked).collect()}
    assert got["A"]["status"] == "ambiguous" and got["A"]["candidates"] == ["id1", "id2"]
    assert got["B"]["status"] == "ambiguous" and got["feature_id:B"]["feature_id"] == "B" and got["symbol:B"]["feature_id"] == "id4"
    assert got["C"]["feature_id"] == "symbol:odd" and got["nope"]["status"] == "unmeasured"
    encoded = spark.createDataFrame([("a b*~/é",)], "s string").select(ids.percent_encode(F.col("s"))).first()[0]
    from urllib.parse import quote
    assert encoded == quote("a b*~/é", safe="")


def test_atlas_totals_and_views(spark):
    cells = spark.range(120).select(F.col("id").alias("cell_id"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    b = atlas.extent(cells).first()
    bounds = (b["x0"], b["y0"], b["x1"], b["y1"])
    pyramid = atlas.density_pyramid(cells, bounds)
    assert {r["level"]: r["n"] for r in pyramid.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {v: 120 for v in atlas.LEVELS}
    assert pyramid.filter("level = 16").agg(F.max("gx")).first()[0] == 15  # the top edge falls into the last bin
    seen = atlas.view(cells, bounds, limit=10, grid=16, pyramid=pyramid, whole=True, total=120)
    assert seen.mode == "aggregate_density" and seen.records.agg(F.sum("count")).first()[0] == 120
    assert atlas.view(cells, (0, 0, 3, 3), limit=100).mode == "exact_points"
    vertices = spark.createDataFrame([("b1", 1, "cell", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
                                     + [("b2", 2, "blob", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])],
                                     "boundary_id string, cell_id int, kind string, vertex int, x double, y double")
    boxes = {r["boundary_id"]: r["problem"] for r in atlas.assemble_boundaries(vertices).collect()}
    assert boxes == {"b1": None, "b2": "unknown_kind"}
    assert atlas.boundary_view(atlas.assemble_boundaries(vertices), (0.5, 0.5, 2, 2)).mode == "exact_boundaries"


def matrix(folder, entries="1 2 7\n2 1 4\n2 1 5\n3 1 99\n", nnz=4, header="%%MatrixMarket matrix coordinate integer general"):
    folder.mkdir(exist_ok=True)
    (folder / "features.tsv").write_text("G1\tA\tGene Expression\nG2\tB\tGene Expression\nC1\tctl\tNegative Control\n")
    (folder / "barcodes.tsv").write_text("a\nb\n")
    (folder / "matrix.mtx").write_text(f"{header}\n% note\n3 2 {nnz}\n{entries}")
    return [str(folder / n) for n in ("matrix.mtx", "features.tsv", "barcodes.tsv")]


def test_matrix_market(spark, tmp_path):
    cells, counts, genes = text.read_matrix_market(spark, *matrix(tmp_path / "m"))
    assert {(r["cell_id"], r["feature_id"]): r["value"] for r in counts.collect()} == {("b", "G1"): 7.0, ("a", "G2"): 9.0}
    assert cells.count() == 2 and genes.count() == 2


@pytest.mark.parametrize("bad", [dict(nnz=5), dict(entries="1 2 7\n2 1 4\n2 1 5\n4 1 99\n"), dict(entries="1 2 7\n2 1 4.5\n2 1 5\n3 1 9\n"), dict(header="%%MatrixMarket matrix array real general")])
def test_matrix_market_rejects(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        text.read_matrix_market(spark, *matrix(tmp_path / "m", **bad))


def test_platform_tables(spark, tmp_path):
    paths = matrix(tmp_path / "m")
    (tmp_path / "tissue.csv").write_text("a,1,0,0,10,20\nb,0,0,1,30,40\n")
    both = text.read_visium(spark, str(tmp_path / "tissue.csv"), *paths, 0.5, False, headerless=True, allow_unannotated=True)
    assert {r["cell_id"]: (r["x"], r["y"], r["region"]) for r in both.cells.collect()} == {"a": (10.0, 5.0, "in_tissue"), "b": (20.0, 15.0, "off_tissue")}
    (tmp_path / "meta.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px\n1 a,1,10,20\n1 a,0,0,0\n")
    (tmp_path / "expr.csv").write_text("fov,cell_ID,G1,Neg\n1 a,1,3,9\n1 a,0,5,5\n")
    args = (str(tmp_path / "meta.csv"), str(tmp_path / "expr.csv"), 0.12, ["G1"])
    cos = text.read_cosmx(spark, *args, exclude_unassigned=True, allow_unannotated=True)
    assert cos.counts.collect()[0].asDict() == {"cell_id": "fov=1%20a;cell=1", "feature_id": "G1", "value": 3.0}
    with pytest.raises(ValueError):
        text.read_cosmx(spark, *args, allow_unannotated=True)
    (tmp_path / "mm.csv").write_text("EntityID,center_x,center_y\n1,5,6\n2,7,8\n")
    (tmp_path / "mc.csv").write_text("cell,G1\n1,2\n3,4\n")
    with pytest.raises(ValueError, match="match exactly"):
        text.read_merscope(spark, str(tmp_path / "mm.csv"), str(tmp_path / "mc.csv"), allow_unannotated=True)
    (tmp_path / "xen.csv").write_text("cell_id,x_centroid,y_centroid,transcript_counts,cell_area\na,1,1,5,NaN\nb,9,9,7,2.5\n")
    window, scope = text.read_xenium(spark, str(tmp_path / "xen.csv"), *paths, allow_unannotated=True, bounds=(0, 0, 2, 2))
    assert window.cells.first()["attributes"]["cell_area"]["kind"] == "null" and scope.first()["source_observation_count"] == 2
    assert scope.first()["selected_entries"] == 1 and registry.get("xenium").inputs[0] == "cells_csv"


def test_snapshot_and_review(spark, tmp_path):
    cells = [{"cell_id": "a", "x": 1.0, "y": 2.0, "label": "L", "counts": {"g": 3, "h": 0}}]
    (tmp_path / "doc.json").write_text(json.dumps({"cells": cells, "metadata": {"name": "n"}}))
    loaded, counts = text.read_snapshot(spark, str(tmp_path / "doc.json"), document=True)
    assert loaded.first()["included"] and [tuple(r) for r in counts.collect()] == [("a", "g", 3.0)]
    written = sinks.write_review(str(tmp_path / "bundle"), {"source": loaded, "target_cells": loaded}, compact=True)
    assert [r["table"] for r in written.collect()] == ["source"] and sinks.check_review(str(tmp_path / "bundle"), spark).count() == 0


def test_masks_and_correspondence(spark):
    cells = spark.createDataFrame([("a", 2.0, 0.0), ("b", 0.0, 2.0), ("c", 99.0, 0.0), ("d", 4.0, 4.0)], "cell_id string, x double, y double")
    pixels = spark.createDataFrame([(1, 0, 7), (0, 1, 8)], "px bigint, py bigint, label bigint")
    names = spark.createDataFrame([(7, "a")], "label bigint, mapped_cell_id string")
    got = {r["cell_id"]: r["correspondence"] for r in I.centroid_pixels(cells, pixels, names, [[2, 0, 0], [0, 2, 0], [0, 0, 1]], 4, 4).collect()}
    assert got == {"a": "same_declared_cell", "b": "mapping_unknown", "c": "outside_image", "d": "background_at_centroid"}
    edges = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 0.9)], "left_id string, right_id string, weight double")
    right = spark.createDataFrame([("x",), ("y",), ("z",)], "cell_id string")
    rules = [r["rule"] for r in V.correspondence(edges, cells, right, "spatial_aggregation").collect()]
    assert rules == ["left_weights_do_not_sum_to_one"]
    assert {r["side"]: r["unmapped_count"] for r in V.unmapped(edges, cells, right).collect()} == {"left": 2, "right": 1}
    with pytest.raises(ValueError):
        V.require_equal_ids(cells, right, "ids")


def test_xenium_areas_and_methods(spark):
    """Negative areas are refused; any method text that is not blank stays text."""
    columns = ["cell_area", "nucleus_count", "segmentation_method"]
    rows = spark.createDataFrame([("3.5", "2", "none"), ("", "NA", " "), ("0", "1", "NA")], columns)
    got = [r.attributes for r in rows.select(text.xenium_attributes(columns)).collect()]
    assert [a["segmentation_method"]["str"] for a in got] == ["none", None, "NA"] and got[1]["segmentation_method"]["kind"] == "null"
    assert [a["cell_area"]["num"] for a in got] == [3.5, None, 0.0] and [a["nucleus_count"]["num"] for a in got] == [2.0, None, 1.0]
    bad = spark.createDataFrame([("-3", "2", "x")], columns).select(text.xenium_attributes(columns))
    with pytest.raises(Exception, match="cell_area"):
        bad.collect()


def test_stored_atlas_is_written_once_and_pushes_filters(spark):
    from cellweave.plans.tables import VIEW, Tables
    path = "/root/testdata/sf0.001"
    first, second = Tables(spark, path).atlas, Tables(spark, path).atlas
    assert first is second and first.boundaries.count() == 2 * first.cells.count()
    plan = atlas.molecules_of(first.transcripts, "Brand#11", VIEW)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(x" in plan.replace("`", "") and "EqualTo(feature" in plan.replace("`", "")


def test_atlas_writes_only_what_is_asked_for(spark, tmp_path):
    """A density level or boundary viewport writes no molecules; molecules of one place are one row of the trees."""
    from cellweave.plans.tables import VIEW, WINDOW, Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    lazy = atlas.Atlas(str(tmp_path), t.cells, t.counts, t.transcripts.unionByName(t.transcripts), t.vertices, WINDOW)
    written = lambda: {p.name for p in tmp_path.iterdir()}
    assert lazy.pyramid.count() and lazy.boundaries.count() and written() == {"pyramid", "boundaries"}
    seen = atlas.stored_view(lambda: lazy.transcripts, lazy.molecule_tree, VIEW, limit=1, grid=16)
    everywhere = t.transcripts.filter(filters.within(VIEW)).count()
    assert seen.total == 2 * everywhere == seen.records.agg(F.sum("count")).first()[0]
    assert written() == {"pyramid", "boundaries", "places", "molecule_tree"}
    assert lazy.molecule_tree.rows.count() == t.transcripts.select("feature", "x", "y").distinct().count()


def test_matrix_of_several_files(spark, tmp_path):
    """Parts of rising size, the first with the header alone: blocks are dealt by size, and the header still comes first."""
    folder = tmp_path / "matrix"
    folder.mkdir()
    entries = [(r, c, r * c) for r in range(1, 41) for c in range(1, 201)]
    header = ["%%MatrixMarket matrix coordinate integer general", "% remark", f"40 200 {len(entries)}"]
    for i, (a, b) in enumerate([(0, 0), (0, 500), (500, 3000), (3000, 8000)]):
        lines = (header if i == 0 else []) + [f"{r} {c} {v}" for r, c, v in entries[a:b]]
        (folder / f"part-{i:05d}.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "features.tsv").write_text("".join(f"g{i}\tG{i}\n" for i in range(1, 41)))
    (tmp_path / "barcodes.tsv").write_text("".join(f"c{i}\n" for i in range(1, 201)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        _, counts, _ = text.read_matrix_market(spark, str(folder), str(tmp_path / "features.tsv"), str(tmp_path / "barcodes.tsv"))
        assert {(r.cell_id, r.feature_id, r.value) for r in counts.collect()} == {(f"c{c}", f"g{r}", v) for r, c, v in entries}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_boundaries_are_dealt_before_they_are_summed(spark):
    """No aggregate over boundaries runs in the tasks of the scan; indexes that repeat are found in rings of any length."""
    rows = [(b, 1, "cell", i % m, float(np_x), float(np_y)) for b, n, m in (("few", 4, 4), ("twice", 4, 3), ("long", 1100, 1100), ("longtwice", 1100, 1000))
            for i, (np_x, np_y) in enumerate((math.cos(2 * math.pi * j / n), math.sin(2 * math.pi * j / n)) for j in range(n))]
    out = atlas.assemble_boundaries(spark.createDataFrame(rows, "boundary_id string, cell_id long, kind string, vertex int, x double, y double"))
    assert {r["boundary_id"]: r["problem"] for r in out.collect()} == {
        "few": None, "twice": "duplicate_vertex_index", "long": "needs_3_to_1000_distinct_vertices", "longtwice": "duplicate_vertex_index"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "vertex#" not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line)


def test_pairs_read_counts_once(spark, tmp_path):
    """The gene's count and the library come from one pass over the counts."""
    spark.createDataFrame([("a", "R", 2.0), ("a", "S", 6.0), ("b", "S", 4.0)], "cell_id string, feature_id string, value double").write.parquet(f"{tmp_path}/counts")
    cells = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "cell_id string, included boolean")
    protein = spark.createDataFrame([(c, "P", 1.0) for c in "abcd"], "cell_id string, feature_id string, value double")
    pairs = PR.rna_protein_pairs(cells, spark.read.parquet(f"{tmp_path}/counts"), protein, "R", ["P"])
    assert {(r.cell_id, r.rna_raw, r.rna_per_10k) for r in pairs.collect()} == {("a", 2.0, 2500.0), ("b", 0.0, 0.0), ("c", 0.0, None)}
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
