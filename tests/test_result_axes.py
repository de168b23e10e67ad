"""Stored result matrices and domains against their axes."""
from cellweave.operators import validate as V


def found(df):
    return {(r["rule"], r["item"]) for r in df.collect()}


def test_matrix_axes(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    axis = spark.createDataFrame([("a",), ("b",)], "feature_id string")
    whole = [(c, f, 1.0) for c in (1, 2, 3) for f in "ab"]
    table = lambda rows: spark.createDataFrame(rows, "cell_id long, feature_id string, value double")
    assert found(V.matrix_axes(table(whole), cells, axis)) == set()
    broken = [r for r in whole if r[:2] != (2, "b")] + [(1, "a", 2.0), (9, "a", 1.0), (3, None, 1.0), (None, "b", float("inf"))]
    assert found(V.matrix_axes(table(broken), cells, axis)) == {
        ("incomplete_row", "2"), ("duplicate_entry", "1|a"), ("row_not_observed", "9|a"), ("row_not_observed", "null|b"),
        ("column_not_on_axis", "3|null"), ("nonfinite_value", "null|b")}
    assert found(V.matrix_axes(table([]), cells, axis)) == {("incomplete_row", str(c)) for c in (1, 2, 3)}
    assert found(V.matrix_axes(table([]), cells.limit(0), axis)) == set()


def test_domain_axis(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    table = lambda rows: spark.createDataFrame(rows, "cell_id long, domain string")
    assert found(V.domain_axis(table([(1, "d"), (2, "e"), (3, "d")]), cells)) == set()
    assert found(V.domain_axis(table([(1, "d"), (1, "d"), (2, None), (7, "d")]), cells)) == {
        ("duplicate_row", "1"), ("cell_without_domain", "2"), ("cell_without_domain", "3"), ("row_not_observed", "7")}


def test_a_family_of_many_metrics(spark):
    from cellweave.operators import study
    metrics = spark.range(300).selectExpr("concat('m', id) as metric")
    sections = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b"), ("s3", 3, "b")], "section_id string, subject_id long, condition string")
    records = metrics.selectExpr("'s1' as section_id", "metric").union(metrics.filter("metric <> 'm7'").selectExpr("'s2'", "metric")).union(
        metrics.filter("metric = 'm1'").selectExpr("'s2'", "'unlisted'"))
    got = [(r["section_id"], r["metric"]) for r in study.missing_sections(records, sections, metrics).collect()]
    assert sorted(got) == sorted([("s2", "m7"), *[("s3", f"m{i}") for i in range(300)]])
    assert study.missing_sections(records, sections, metrics.limit(0)).count() == 0
