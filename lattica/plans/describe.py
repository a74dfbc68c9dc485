"""Generated descriptions of entities, the texts that are embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text


def _first(condition: Column, value: Column, order: Column, n: int = 5) -> Column:
    """The first n values of a group, by order, joined; null if there are none."""
    got = F.slice(F.transform(F.array_sort(F.collect_set(F.when(condition, F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"]), 1, n)
    return F.when(F.size(got) > 0, F.array_join(got, ", "))


def type_descriptor() -> Column:
    """Columns node_type, kind, subtype as a word."""
    container = F.when(F.col("kind") == "file", "file").otherwise(F.coalesce("subtype", "kind", F.lit("type")))
    return F.when(F.col("node_type") == "Container", container).when(F.col("node_type") == "Callable", F.coalesce("kind", F.lit("function"))).otherwise(F.coalesce("kind", F.lit("variable")))


def description() -> Column:
    """Visibility, modifiers, type, name and up to three decorators."""
    m = lambda c: F.col(f"metadata.{c}")
    flags = [F.when(m(c), F.lit(c)) for c in ("static", "async", "abstract", "virtual")]
    words = F.array_distinct(F.concat(F.array_compact(F.array(m("visibility"), *flags)), F.coalesce(m("modifiers"), F.array().cast("array<string>"))))
    decorators = F.when(F.size(F.coalesce(m("decorators"), F.array().cast("array<string>"))) > 0, F.concat(F.lit("decorated with "), F.array_join(F.slice(m("decorators"), 1, 3), ", ")))
    return F.concat_ws(" ", F.array_join(words, " "), type_descriptor(), "name", decorators)


def with_content(nodes: DataFrame, files: DataFrame, span: bool = False) -> DataFrame:
    """nodes with `content`: their lines, or with span their whole declaration. files: path, text. The text of a file is joined to each of its nodes: for files of few entities; a stored graph has the lines themselves as `text`."""
    f = files.select(F.col("path").alias("_path"), F.col("text").alias("_source"))
    first, last = (F.coalesce("span_start", "line"), F.coalesce("span_end", "end_line")) if span else (F.col("line"), F.col("end_line"))
    return nodes.join(f, F.col("file") == F.col("_path"), "left").withColumn("content", F.coalesce(text.lines(F.col("_source"), first, last), F.lit(""))).drop("_path", "_source")


def describe(nodes: DataFrame, edges: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """nodes (with content), or those of `about`, with `semantic_text`: description, inheritance, parameters, members, parent, file, references, keywords and a preview, joined by `. `."""
    n = nodes.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("node_type").alias("_type"), F.col("kind").alias("_kind"), F.col("subtype").alias("_sub"), F.col("line").alias("_line"))
    about = nodes if about is None else about
    ids = about.select(F.col("id").alias("_own"))
    out = edges.join(ids, F.col("source") == F.col("_own"), "left_semi").join(n, F.col("target") == F.col("_id"))
    name, uses, has = F.col("_name"), F.col("edge_type") == "USES", F.col("edge_type") == "CONTAINS"
    label = lambda word, c: F.concat(F.lit(f"{word} "), c)
    kids = out.groupBy(F.col("source").alias("_s")).agg(
        _first(has & F.col("_kind").isin("method", "constructor", "function"), name, F.col("_line")).alias("_methods"),
        _first(has & (F.col("_kind") == "property"), name, F.col("_line")).alias("_properties"),
        _first(has & (F.col("_kind") == "field"), name, F.col("_line")).alias("_fields"),
        _first(uses & (F.col("_type") == "Callable"), name, name).alias("_calls"),
        _first(uses & (F.col("_type") == "Container"), name, name).alias("_types"),
        _first(uses & (F.col("_type") == "Data"), name, name).alias("_data"),
        _first(uses & (F.col("_type") == "Container") & F.coalesce(F.col("_sub") == "interface", F.lit(False)), name, name).alias("_implements"),
        _first(uses & (F.col("_type") == "Container") & ~F.coalesce(F.col("_sub") == "interface", F.lit(False)), name, name).alias("_extends"),
    )
    above = edges.where("edge_type = 'CONTAINS'").join(ids, F.col("target") == F.col("_own"), "left_semi").join(n, F.col("source") == F.col("_id")).where("_kind <> 'file' and _kind <> 'repository'").groupBy(F.col("target").alias("_t")).agg(F.min_by("_name", "source").alias("_parent"))
    all_ = about.join(kids, F.col("id") == F.col("_s"), "left").join(above, F.col("id") == F.col("_t"), "left")
    container, callable_ = F.col("node_type") == "Container", F.col("node_type") == "Callable"
    is_file = F.coalesce(F.col("kind") == "file", F.lit(False))
    members = F.concat_ws(", ", label("methods:", F.col("_methods")), label("properties:", F.col("_properties")), label("fields:", F.col("_fields")))
    refs = F.concat_ws(", ", label("calls", F.col("_calls")), label("uses types", F.col("_types")), label("uses", F.col("_data")))
    words = text.keywords(F.col("name"), F.col("content"), F.col("metadata.scope"))
    parts = [
        description(),
        F.when(container, F.nullif(F.concat_ws(", ", label("extends", F.col("_extends")), label("implements", F.col("_implements"))), F.lit(""))),
        F.when(callable_, F.concat(F.lit("("), text.parameters(F.col("content")), F.lit(")"))),
        F.when(container & ~is_file, F.nullif(members, F.lit(""))),
        label("in", F.col("_parent")),
        label("in file", paths.short_path(F.coalesce("file", F.lit("")))),
        F.nullif(refs, F.lit("")),
        F.when(F.size(words) > 0, F.concat(F.lit("related to: "), F.array_join(words, ", "))),
        F.concat(F.lit("code: "), F.nullif(text.preview(F.col("content")), F.lit(""))),
    ]
    return all_.select(*about.columns, F.concat_ws(". ", *parts).alias("semantic_text"))
