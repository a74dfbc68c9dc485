"""Simple paths, reachability and cycles, as depth-bounded joins.

Each step is a join of a frontier with the edges. A frontier is written to the
shared folder (of chains every few steps), so that plans stay short and lost
executors cost no more than those steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

EVERY = 3


def _links(edges: DataFrame, edge_types: list[str] | None, upstream: bool) -> DataFrame:
    e = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    a, b = ("target", "source") if upstream else ("source", "target")
    return e.select(F.col(a).alias("_from"), F.col(b).alias("_to"))


def chains(edges: DataFrame, starts: DataFrame, depth: int = 3, edge_types: list[str] | None = None, upstream: bool = True, most: int | None = None) -> DataFrame:
    """(start, path, length): simple paths from each start (id) over links, ending at `depth` steps or where no unvisited node follows; the first `most` of each start by path."""
    links = _links(edges, edge_types or ["USES"], upstream).distinct()
    live = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    ended = None
    for step in range(1, depth + 1):
        at = F.element_at("path", -1)
        grown = live.join(links, (at == F.col("_from")) & ~F.array_contains(F.col("path"), F.col("_to")), "left")
        if step > 1:
            stop = grown.where("_to is null").select("start", "path")
            ended = stop if ended is None else ended.unionByName(stop)
        live = grown.where("_to is not null").select("start", F.concat("path", F.array("_to")).alias("path"))
        if step % EVERY == 0 and step < depth:
            live = cut(live)
    out = live if ended is None else live.unionByName(ended)
    out = out.withColumn("length", F.size("path"))
    if most is None:
        return out
    return out.withColumn("_r", F.expr("row_number() over (partition by start order by path)")).where(F.col("_r") <= most).drop("_r")


def reachable(edges: DataFrame, starts: DataFrame, edge_types: list[str] | None = None, upstream: bool = False, depth: int | None = None) -> DataFrame:
    """(start, id, depth): nodes within `depth` links of each start, or any number, with the least number."""
    links = _links(edges, edge_types, upstream)
    first = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    # links may repeat: what a step finds is made distinct anyway
    links = cut(links)
    # every step is a table of its own; what was seen is the union of them, never written again
    steps = [cut(first)]
    while depth is None or len(steps) <= depth:
        seen = reduce(DataFrame.unionByName, steps).select("start", "id")
        new = cut(steps[-1].join(links, F.col("id") == F.col("_from")).select("start", F.col("_to").alias("id")).distinct().join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(len(steps))))
        if new.isEmpty():
            break
        steps.append(new)
    return reduce(DataFrame.unionByName, steps)


def dependencies(edges: DataFrame, starts: DataFrame, depth: int = 10, reverse: bool = False) -> DataFrame:
    """(start, source, target, depth): every DEPENDS_ON edge out of a node that is reached in fewer than `depth` links; an edge to a node seen before is listed but not followed."""
    nodes = reachable(edges, starts, ["DEPENDS_ON"], reverse, depth - 1)
    links = _links(edges, ["DEPENDS_ON"], reverse).distinct()
    return nodes.join(links, F.col("id") == F.col("_from")).select("start", F.col("_from").alias("source"), F.col("_to").alias("target"), (F.col("depth") + 1).alias("depth"))


def on_cycles(edges: DataFrame, edge_type: str = "CONTAINS") -> DataFrame:
    """(id): nodes left when those without incoming edges are taken away again and again; empty if there is no cycle."""
    links = cut(_links(edges, [edge_type], False))
    # without a cycle nothing is left either when nodes without outgoing edges go as well, and the many leaves go first
    if not _peeled(links, True).isEmpty():
        return _peeled(links, False).select(F.explode(F.array("_from", "_to")).alias("id")).distinct()
    return links.select(F.col("_from").alias("id")).limit(0)


def _peeled(links: DataFrame, both: bool) -> DataFrame:
    """The links left when those from nodes without incoming ones, with both also those to nodes without outgoing ones, are taken away until none goes."""
    left, n = links, None
    while True:
        to, of = left.select(F.col("_to").alias("_t")), left.select(F.col("_from").alias("_f"))
        rest = left.join(to, F.col("_from") == F.col("_t"), "left_semi")
        rest = cut(rest.join(of, F.col("_to") == F.col("_f"), "left_semi") if both else rest)
        m = rest.count()
        if not m or m == n:
            return rest
        left, n = rest, m


def ascii_tree(name: str, links: dict[str, list[str]], depth: int = 0, above: tuple[str, ...] = ()) -> str:
    """An indented tree of names; a name that is above itself is marked and not entered."""
    if name in above:
        return f"{'  ' * depth}{name} (circular)\n"
    return f"{'  ' * depth}{name}\n" + "".join(ascii_tree(x, links, depth + 1, (*above, name)) for x in sorted(links.get(name, [])))


def draw(rows: list[tuple[str, str]], form: str = "dot") -> str:
    """Edges between names as dot, mermaid or ascii."""
    rows = sorted(set(rows))
    if form == "dot":
        return "digraph components {\n" + "".join(f'  "{a}" -> "{b}";\n' for a, b in rows) + "}\n"
    if form == "mermaid":
        ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in r}))}
        return "graph TD\n" + "".join(f'  {ids[a]}["{a}"] --> {ids[b]}["{b}"]\n' for a, b in rows)
    if form == "ascii":
        links: dict[str, list[str]] = {}
        for a, b in rows:
            links.setdefault(a, []).append(b)
        tops = sorted(set(links) - {b for _, b in rows}) or sorted(links)[:1]
        return "".join(ascii_tree(t, links) for t in tops)
    raise ValueError(f"format {form!r}")
