"""Selections, observation queries, feature lookup and paging."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import predicates as P
from ..functions.geometry import polygon_contains
from ..functions.ids import UNANNOTATED


class UnmeasuredFeature(ValueError):
    """A feature outside the panel is unknown, never zero."""


def require_measured(features: DataFrame, wanted: Sequence[str]) -> None:
    found = {r[0] for r in features.filter(F.col("feature_id").isin(*wanted)).select("feature_id").distinct().collect()}
    missing = sorted(set(wanted) - found)
    if missing:
        raise UnmeasuredFeature(f"not measured on this panel: {missing}")


def within(bounds: Sequence[float], x: str = "x", y: str = "y") -> Column:
    x0, y0, x1, y1 = map(float, bounds)
    if not (x0 < x1 and y0 < y1):
        raise ValueError("bounds must be [xmin, ymin, xmax, ymax] with positive area")
    return F.col(x).between(x0, x1) & F.col(y).between(y0, y1)


def attach_counts(cells: DataFrame, counts: DataFrame, features: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, dict[str, Column | None]]:
    """Add one zero-filled column per measured feature; unmeasured ones map to None."""
    on_panel = {r[0] for r in features.filter(F.col("feature_id").isin(*wanted)).select("feature_id").distinct().collect()}
    names = {f: f"_count{i}" for i, f in enumerate(wanted) if f in on_panel}
    if not names:
        return cells, {f: None for f in wanted}
    wide = (counts.filter(F.col("feature_id").isin(*names)).groupBy("cell_id")
            .agg(*[F.sum(F.when(F.col("feature_id") == f, F.col("value"))).alias(c) for f, c in names.items()]))
    out = cells.join(wide, "cell_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names.values()})
    return out, {f: F.col(names[f]) if f in names else None for f in wanted}


def query_observations(cells: DataFrame, counts: DataFrame | None = None, features: DataFrame | None = None, *,
                       labels: Sequence[str] | None = None, included: bool | None = None,
                       bounds: Sequence[float] | None = None, gene: str | None = None, min_count: float = 0.0,
                       attribute: tuple[str, str, object] | None = None) -> DataFrame:
    """Conjunction of the given filters; ``attribute_match`` stays NULL where the attribute is unavailable."""
    out = cells
    if labels is not None:
        out = out.filter(F.col("label").isin(*labels)) if labels else out.filter(F.lit(False))
    if included is not None:
        out = out.filter(F.col("included") == included)
    if bounds is not None:
        out = out.filter(within(bounds))
    if gene is not None:
        require_measured(features, [gene])
        out, columns = attach_counts(out, counts, features, [gene])
        out = out.filter(columns[gene] >= float(min_count)).withColumn("marker_count", columns[gene]).drop("_count0")
    elif min_count:
        raise ValueError("min_count needs a measured gene")
    if attribute is not None:
        field, op, value = attribute
        out = out.withColumn("attribute_match", P.typed_compare(F.col("attributes")[field], op, value))
    return out


def matching(queried: DataFrame) -> DataFrame:
    return queried.filter("attribute_match").drop("attribute_match") if "attribute_match" in queried.columns else queried


def unavailable_count(queried: DataFrame) -> DataFrame:
    """Rows that pass every other filter but whose attribute cannot be compared."""
    return queried.agg(F.count_if(F.col("attribute_match").isNull()).alias("attribute_unavailable_count"),
                       F.count_if(F.col("attribute_match")).alias("matching_count"))


def resolve_selector(cells: DataFrame, clauses: Sequence[Mapping[str, object]], counts: DataFrame, features: DataFrame) -> DataFrame:
    """Split observations into chosen and unknown under the three-valued conjunction."""
    wanted = sorted({str(c["field"])[7:] for c in clauses if str(c["field"]).startswith("counts.")})
    out, columns = attach_counts(cells, counts, features, wanted) if wanted else (cells, {})
    truth = P.all_of(clauses, columns)
    return (out.withColumn("_truth", truth).filter("_truth or _truth is null")
            .select("cell_id", F.when(F.col("_truth"), "chosen").otherwise("unknown").alias("resolution")))


def select_ids(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    return cells.join(wanted.select("cell_id"), "cell_id", "left_semi")


def unknown_or_duplicate_ids(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    unknown = wanted.join(cells.select("cell_id"), "cell_id", "left_anti").select("cell_id", F.lit("unknown").alias("problem"))
    twice = wanted.groupBy("cell_id").count().filter("count > 1").select("cell_id", F.lit("duplicate").alias("problem"))
    return unknown.distinct().unionByName(twice)


def select_polygon(cells: DataFrame, polygon: Sequence[Sequence[float]]) -> DataFrame:
    """Centroids inside or on the polygon; excluded cells are selected too."""
    return cells.filter(polygon_contains(F.col("x"), F.col("y"), polygon))


def viewport(cells: DataFrame, bounds: Sequence[float], limit: int) -> tuple[DataFrame, int]:
    """(points, total): exact points when they fit the budget, otherwise no points but the count."""
    inside = cells.filter(within(bounds))
    total = inside.count()
    return (inside if total <= limit else inside.limit(0)), total


def resolve_features(features: DataFrame, queries: DataFrame) -> DataFrame:
    """Resolve text queries (column ``query``) by id or symbol, honouring feature_id: and symbol: prefixes."""
    q = queries.select("query").distinct()
    kind = F.when(F.startswith("query", F.lit("feature_id:")), "feature_id").when(F.startswith("query", F.lit("symbol:")), "symbol").otherwise("auto")
    q = q.withColumn("_kind", kind).withColumn("_value", F.when(F.col("_kind") == "auto", F.col("query"))
                                              .otherwise(F.expr("substring(query, length(_kind) + 2)")))
    names = (features.select("feature_id", F.col("feature_id").alias("_value"), F.lit("feature_id").alias("_space"))
             .unionByName(features.filter("symbol is not null").select("feature_id", F.col("symbol").alias("_value"), F.lit("symbol").alias("_space"))))
    hits = q.join(names, "_value").filter("_kind = 'auto' or _kind = _space").groupBy("query").agg(F.array_sort(F.collect_set("feature_id")).alias("candidates"))
    size = F.coalesce(F.size("candidates"), F.lit(0))
    return q.join(hits, "query", "left").select(
        "query", F.when(size == 1, "resolved").when(size > 1, "ambiguous").otherwise("unmeasured").alias("status"),
        F.when(size == 1, F.col("candidates")[0]).alias("feature_id"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def ambiguous_symbols(features: DataFrame) -> DataFrame:
    return features.filter("symbol is not null").groupBy("symbol").agg(F.count("*").alias("feature_count")).filter("feature_count > 1")


def search_features(features: DataFrame, text: str) -> DataFrame:
    needle = F.lower(F.lit(text))
    marked = features.join(ambiguous_symbols(features).select("symbol", F.lit(True).alias("_twice")), "symbol", "left")
    return (marked.filter(F.contains(F.lower("feature_id"), needle) | F.contains(F.lower(F.coalesce("symbol", F.lit(""))), needle))
            .select("feature_id", "symbol", F.coalesce("_twice", F.lit(False)).alias("symbol_ambiguous")))


def keyset_page(rows: DataFrame, after: object | None, limit: int, key: str = "cell_id") -> DataFrame:
    """Next page by key order; each page is a bounded top-n, no offset scan."""
    out = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    return out.orderBy(key).limit(limit)


def page_binding(**parts: object) -> str:
    """Digest that ties a cursor to its revision, source and filters."""
    import hashlib
    import json
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def bound_page(rows: DataFrame, cursor: Mapping[str, object] | None, limit: int, key: str = "cell_id", **binding: object) -> DataFrame:
    """A keyset page whose rows carry the binding; a cursor of another revision, source or filter is refused."""
    mine = page_binding(**binding)
    if cursor is not None and cursor["binding"] != mine:
        raise ValueError("the cursor belongs to another revision, source or filter")
    return keyset_page(rows, None if cursor is None else cursor["after"], limit, key).withColumn("binding", F.lit(mine))


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def ranked(rows: DataFrame, q: str, score: str, *ids: str) -> list[Column]:
    """Result-table order: q ascending with untested rows last, then score descending, then ids."""
    return [F.col(q).asc_nulls_last(), F.coalesce(score, F.lit(0.0)).desc(), *[F.col(i).asc() for i in ids]]


def classify_excess(excess: Column, threshold: float) -> Column:
    return (F.when(excess.isNull(), "inconclusive").when(excess >= threshold, "descriptive_supported").otherwise("descriptive_not_supported"))


def marker_programs(cells: DataFrame, counts: DataFrame, programs: Mapping[str, Sequence[str]], minimum_count: float,
                    minimum_markers: int, both: str, neither: str) -> DataFrame:
    """Label cells by how many genes of two programs reach a raw count; the supports are kept."""
    (name_a, genes_a), (name_b, genes_b) = programs.items()
    hit = counts.filter(F.col("value") >= minimum_count)
    support = hit.filter(F.col("feature_id").isin(*genes_a, *genes_b)).groupBy("cell_id").agg(
        F.count_if(F.col("feature_id").isin(*genes_a)).alias("_a"), F.count_if(F.col("feature_id").isin(*genes_b)).alias("_b"))
    out = cells.select("cell_id").join(support, "cell_id", "left").select(
        "cell_id", F.coalesce("_a", F.lit(0)).alias("support_a"), F.coalesce("_b", F.lit(0)).alias("support_b"))
    a, b = F.col("support_a") >= minimum_markers, F.col("support_b") >= minimum_markers
    return out.withColumn("label", F.when(a & b, both).when(a, name_a).when(b, name_b).otherwise(neither))


def label_status(cells: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("label") == UNANNOTATED)
    return cells.agg(missing.alias("unannotated_count"), F.when(missing == F.count("*"), "unannotated").when(missing > 0, "partially_unannotated")
                     .otherwise("provided_working_labels").alias("annotation_status"))


def semantics(slices: DataFrame) -> DataFrame:
    unit = F.coalesce("observation_unit", F.lit("cell"))
    return slices.select("slice_id", unit.alias("observation_unit"),
                         F.when(unit == "cell", "cell_type").otherwise(F.concat(unit, F.lit("_annotation"))).alias("label_semantics"),
                         F.when(unit == "cell", "working cell labels; centroid proximity is not contact")
                         .otherwise("annotations of captured regions, not pure cell identities").alias("interpretation"))


def require_physical_units(slices: DataFrame) -> None:
    if slices.filter(F.coalesce("units", F.lit("unknown")) != "micrometer").limit(1).count():
        raise ValueError("radius analysis needs micrometer coordinates")


def examples(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """First rows by key plus how many were left out (a count, so nothing is hidden)."""
    total = rows.agg(F.count("*").alias("_n"))
    shown = rows.orderBy(key).limit(limit).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return shown.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select(
        "examples", (F.col("_n") - F.size("examples")).alias("omitted"))


def compose(cells: DataFrame, roi: DataFrame | None = None) -> DataFrame:
    """Label counts and fractions over included selected cells; totals repeat on every row."""
    chosen = cells if roi is None else select_ids(cells, roi)
    per_label = chosen.groupBy("label").agg(F.count_if("included").alias("count"), F.count_if(~F.col("included")).alias("_x"))
    every = W.partitionBy(F.lit(1))  # one row per label by now
    out = per_label.withColumns({"selected_included": F.sum("count").over(every), "selected_excluded": F.sum("_x").over(every)})
    return out.filter("count > 0").select("label", "count", (F.col("count") / F.col("selected_included")).alias("fraction"),
                                          "selected_included", "selected_excluded",
                                          (F.col("selected_included") + F.col("selected_excluded")).alias("selected_total"))
