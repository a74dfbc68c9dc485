"""Column functions that classify queries and score names, types and paths. A query may be a string or a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query type to the weights of the semantic and the code list.
WEIGHTS = {"Identifier": (0.5, 0.5), "Question": (0.9, 0.1), "Natural": (0.75, 0.25)}
RRF_K, RRF_SCALE = 60, 30
EXACT, SEPARATORS, INSIDE, AROUND, TYPE, SOURCE, TEST = 0.35, 0.25, 0.15, 0.08, 0.08, 0.06, -0.03
_STARTERS = ("are", "can", "do", "does", "how", "is", "what", "when", "where", "which", "who", "why")


def _col(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def classify_query(query: str | Column) -> Column:
    """Question, Identifier or Natural."""
    q = _trim(_col(query))
    question = q.endswith("?") | F.split(F.lower(q), r"\s+")[0].isin(*_STARTERS)
    token = F.replace(q, F.lit(" "), F.lit("")).rlike("^[A-Za-z_][A-Za-z0-9_-]*$")
    code = q.contains("_") | q.contains("-") | q.rlike("[a-z][A-Z]") | (~q.contains(" ") & q.rlike("^[A-Z]"))
    return F.when(question, "Question").when(token & code, "Identifier").otherwise("Natural")


def name_variants(query: str | Column) -> Column:
    """The query as it is, in lower and upper case, and with its first letter in either."""
    q = _col(query)
    first, rest = F.substring(q, 1, 1), F.substring(q, 2, 1 << 30)
    return F.array_distinct(F.array(q, F.lower(q), F.upper(q), F.concat(F.upper(first), rest), F.concat(F.lower(first), rest)))


def exact_match_bonus(query: str | Column, name: Column) -> Column:
    """For equal names, names equal but for separators, and names inside one another; lengths are bytes."""
    q, n = _trim(F.lower(_col(query))), _trim(F.lower(name))
    bare = lambda x: F.regexp_replace(x, "[_-]", "")
    ratio = F.octet_length(q) / F.octet_length(n)
    inside = F.when(F.contains(n, q), F.when(ratio > 0.3, INSIDE * ratio).otherwise(0.0)).when(F.contains(q, n) & (F.octet_length(n) >= 3), AROUND).otherwise(0.0)
    return F.when(q == n, EXACT).when(bare(q) == bare(n), SEPARATORS).when(F.octet_length(q) >= 3, inside).otherwise(0.0)


def _has(q: Column, *words: str) -> Column:
    return q.rlike("|".join(words))


def type_bonus(query: str | Column, node_type: Column) -> Column:
    """When the query names the type it looks for; only the first kind of word it holds counts."""
    q, t = F.lower(_col(query)), F.lower(node_type)
    want = F.when(_has(q, "class", "type"), "container").when(_has(q, "def", "function", "method"), "callable").when(_has(q, "field", "property", "variable"), "data")
    return F.when(want == t, TYPE).otherwise(0.0)


def context_boost(query: str | Column, path: Column) -> Column:
    """Sources are lifted; tests lowered unless the query is about tests."""
    q, p = F.lower(_col(query)), F.lower(path)
    source = p.contains("/src/") & ~p.contains("/test") & ~p.contains("/tools/")
    return F.when(source, SOURCE).when(p.contains("/test") & ~q.contains("test"), TEST).otherwise(0.0)


def rescale(score: Column) -> Column:
    """Score of a single list: 1.3 s up to 0.5, then 0.65 (s - 0.5) / 0.5 (not monotonic, as it must be)."""
    return F.when(score <= 0.5, score * 1.3).otherwise(0.65 * (score - 0.5) / 0.5)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l2_normal(v: Column) -> Column:
    """A vector of length 1; null for the zero vector."""
    norm = F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(v, lambda x: (x / norm).cast("float")))
