"""Exact vector search, fusion of ranked lists, and search over workspaces.

A list is the top `pool` rows by score, found by a partial top-k in every task
and one merge; nothing is shuffled before that. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranking
from .lookup import type_filter

NAME_HITS, VARIANT_HITS = 10, 5


def pool_size(limit: int) -> int:
    return max(50, 4 * limit)


def knn(points: DataFrame, query: list[float], limit: int, id_: str = "entity_id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """points with `score`, the cosine with query: the `limit` highest. Vectors of another length, or none, are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    own = points if where is None else points.where(where)
    scored = own.where(F.size(vector) == len(query)).withColumn("score", ranking.cosine(F.col(vector), q)).where("score is not null")
    return scored.drop(vector).orderBy(F.desc("score"), id_).limit(limit)


def by_name(points: DataFrame, names: list[str], each: int) -> DataFrame:
    """Up to `each` points of each exact name, with score 1."""
    w = Window.partitionBy("name").orderBy("entity_id")
    hit = points.where(F.col("name").isin(*names)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")
    return hit.drop("vector").withColumn("score", F.lit(1.0))


def ranked(hits: DataFrame, via: str) -> DataFrame:
    """hits with their rank from 0 by score; the list is at most a pool long, so one task ranks it."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity_id")) - 1).withColumn("via", F.lit(via))


def fuse(semantic: DataFrame, code: DataFrame, names: DataFrame | None, query: str, query_type: str) -> DataFrame:
    """Weighted reciprocal rank fusion with bonuses. Lists: entity_id, name, type, file_path, score.

    (entity_id, name, type, file_path, score, found_via, semantic_score, code_score); the details are those of the name hit, else the semantic, else the code hit."""
    ws, wc = ranking.WEIGHTS[query_type]
    lists = [ranked(semantic, "semantic"), ranked(code, "code")] + ([ranked(names, "name")] if names is not None else [])
    cols = ["entity_id", "name", "type", "file_path", "score", "rank", "via"]
    union = reduce(DataFrame.unionByName, [x.select(*cols) for x in lists])
    of = lambda v, c: F.max(F.when(F.col("via") == v, F.col(c)))
    order = F.when(F.col("via") == "name", 0).when(F.col("via") == "semantic", 1).otherwise(2)
    primary = F.min_by(F.struct("name", "type", "file_path"), order)
    g = union.groupBy("entity_id").agg(primary.alias("_p"), of("semantic", "rank").alias("_rs"), of("code", "rank").alias("_rc"), of("name", "rank").alias("_rn"), of("semantic", "score").alias("semantic_score"), of("code", "score").alias("code_score")).select("*", "_p.*")
    share = lambda w, r: F.coalesce(F.lit(w) / (ranking.RRF_K + F.col(r) + 1.0), F.lit(0.0))
    named = F.col("_rn").isNotNull()
    base = share(ws, "_rs") + share(wc, "_rc") + F.when(named, 1.0 / (ranking.RRF_K + 1.0)).otherwise(0.0)
    exact = F.when(named, ranking.EXACT).otherwise(ranking.exact_match_bonus(query, F.col("name")))
    score = ranking.clamp(base * ranking.RRF_SCALE + exact + ranking.type_bonus(query, F.col("type")) + ranking.context_boost(query, F.col("file_path")))
    via = F.array_compact(F.array(F.when(F.col("_rs").isNotNull(), "semantic"), F.when(F.col("_rc").isNotNull(), "code"), F.when(named, "name")))
    return g.select("entity_id", "name", "type", "file_path", score.alias("score"), via.alias("found_via"), "semantic_score", "code_score")


def top(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "entity_id").limit(limit)


def query_type(query: str) -> str:
    """classify_query of one text, on the driver."""
    import re

    q = re.sub(r"^\s+|\s+$", "", query)
    words = q.lower().split()
    if q.endswith("?") or words and words[0] in ranking._STARTERS:
        return "Question"
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", q.replace(" ", "")) and ("_" in q or "-" in q or re.search("[a-z][A-Z]", q) or " " not in q and q[:1].isupper()):
        return "Identifier"
    return "Natural"


def _variants(query: str) -> list[str]:
    return list(dict.fromkeys([query.lower(), query.upper(), query[:1].upper() + query[1:], query[:1].lower() + query[1:]]))


def hybrid(semantic_points: DataFrame, code_points: DataFrame, query: str, semantic_vector: list[float], code_vector: list[float], limit: int, types: list[str] | None = None) -> DataFrame:
    """Both vector lists, fused; queries that look like an identifier add points of that name, or else of its case variants. With types there is no name list."""
    kind, pool = query_type(query), pool_size(limit)
    where = type_filter(types, "type")
    s = knn(semantic_points, semantic_vector, pool, where=where)
    c = knn(code_points, code_vector, pool, where=where)
    names = None
    if kind == "Identifier" and not types:
        text = query.strip()
        names = by_name(semantic_points, [text], NAME_HITS)
        if names.isEmpty():
            names = by_name(semantic_points, [v for v in _variants(text) if v != text], VARIANT_HITS)
    return top(fuse(s, c, names, query, kind), limit)


def single(points: DataFrame, query: str, vector: list[float], limit: int, via: str, types: list[str] | None = None) -> DataFrame:
    """One vector list, rescaled, with bonuses."""
    hits = knn(points, vector, pool_size(limit), where=type_filter(types, "type"))
    score = ranking.clamp(ranking.rescale(F.col("score")) + ranking.exact_match_bonus(query, F.col("name")) + ranking.type_bonus(query, F.col("type")) + ranking.context_boost(query, F.col("file_path")))
    raw = {f"{v}_score": F.col("score") if v == via else F.lit(None).cast("double") for v in ("semantic", "code")}
    return top(hits.select("entity_id", "name", "type", "file_path", score.alias("score"), F.array(F.lit(via)).alias("found_via"), *[c.alias(n) for n, c in raw.items()]), limit)


def by_mode(mode: str | None, semantic_points: DataFrame, code_points: DataFrame, query: str, semantic_vector: list[float], code_vector: list[float], limit: int, types: list[str] | None = None) -> DataFrame:
    """`code`, `info`, or else hybrid."""
    if mode == "code":
        return single(code_points, query, code_vector, limit, "code", types)
    if mode == "info":
        return single(semantic_points, query, semantic_vector, limit, "semantic", types)
    return hybrid(semantic_points, code_points, query, semantic_vector, code_vector, limit, types)


def merge_workspaces(hits: DataFrame, limit: int, each: int | None = None) -> DataFrame:
    """(id, workspace, score): the best `each` (2 limit) of each workspace, ids prefixed, best first, one row an id. hits: workspace, id, score."""
    w = Window.partitionBy("workspace").orderBy(F.desc("score"), "id")
    own = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= (each or 2 * limit))
    out = own.select(F.concat("workspace", F.lit("::"), "id").alias("id"), "workspace", "score")
    return out.groupBy("id", "workspace").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)
