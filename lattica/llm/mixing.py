"""Operator 6: mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent a and normalised:
a = 1 keeps the natural mixture, a = 0 makes it uniform. The entropy of the
weights falls as a grows, so a is found by bisection: the largest a in [0, 1]
whose entropy reaches `entropy` (a share of the logarithm of the number of
sources). If some source would then be read more than `repeats` times, a is
raised, again by bisection, until none is.

The weights are then realised. With a budget of B tokens, source s may spend
floor(B * w_s). A budget of more than `repeats` times all tokens cannot be kept to
and counts as that many. Its documents are cut into blocks, ranges of `block` consecutive
doc_ids. Each epoch permutes the blocks by a hash keyed with the epoch; inside a
block the order is that of doc_id. Whole epochs come first, then one more as far
as the budget lasts: a document is taken when the tokens before it in that epoch
are less than what is left.

Defined results. Tokens are the words between white space; a null text or one
without words has none. A null source is a source of its own. Sources without
tokens get no weight and no rows. Rows without doc_id form one block, before
the others in order; equal doc_ids come in order of a hash of their texts, and
rows alike in doc_id, source and text are taken together. Other columns pass
through untouched. An empty table gives an empty result.

Scale. Token counts are one aggregation; a source is one row, so the table of
sources is what the driver holds. Where the last epoch ends is found without
sorting a source: the block keys are uniform, so sums over 4096 key ranges tell
the range that holds the end, and only that range is ordered. Whether a row is
taken then depends on the row and its source alone: texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store

ENTROPY, REPEATS, BLOCK, SEED = 0.95, 4.0, 64, 11
STEPS = 60
#: Rows of a table of sources that is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_SOURCES = 200_000
OPTIONS = {"budget": None, "entropy": ENTROPY, "repeats": REPEATS, "block": BLOCK, "seed": SEED}


def exponent(tokens: list[int], budget: int, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for sources of these token counts (all positive)."""
    total = sum(tokens)
    shares = [t / total for t in tokens]

    def weights(a: float) -> list[float]:
        raw = [p**a for p in shares]
        whole = sum(raw)
        return [x / whole for x in raw]

    def last(good) -> float:
        """The largest a of [0, 1] for which good, true for small a only, holds."""
        if good(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    goal = entropy * math.log(len(tokens)) if len(tokens) > 1 else 0.0
    a = last(lambda x: -sum(w * math.log(w) for w in weights(x)) >= goal)
    too_often = lambda x: max(w * budget / t for w, t in zip(weights(x), tokens, strict=True)) > repeats
    return max(a, last(too_often)) if too_often(a) else a


def token_count(text: str = "text") -> Column:
    """Words between white space; null and blank texts have none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def plan(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[list[dict], float]:
    """Per source: tokens, weight and budget (of `budget` tokens, by default as many as there are), and the exponent."""
    stats = docs.select(F.col("`source`").alias("s"), token_count().alias("n")).groupBy("s").agg(F.sum("n").alias("n")).where("n > 0")
    return _plan(sorted(((r.s, r.n) for r in stats.collect()), key=lambda x: (x[0] is not None, x[0] or "")), budget, entropy, repeats)


def _plan(sources: list[tuple], budget: int | None, entropy: float, repeats: float) -> tuple[list[dict], float]:
    if not sources:
        return [], 1.0
    total = sum(n for _, n in sources)
    budget = min(total if budget is None else budget, math.floor(repeats * total))
    a = exponent([n for _, n in sources], budget, entropy, repeats)
    raw = [(n / total) ** a for _, n in sources]
    whole = sum(raw)
    return [{"source": s, "tokens": n, "weight": r / whole, "budget": math.floor(budget * (r / whole))} for (s, n), r in zip(sources, raw, strict=True)], a


def draws(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, perm_key): every taken copy of a document. Sorted by epoch, perm_key, block and doc_id the rows of a source are in the order of its permutations."""
    opts = OPTIONS | options
    narrow = _narrow(docs, opts)
    taken = _taken(narrow, _ends(narrow, opts), opts)
    return taken.select(F.col("_id").alias("doc_id"), F.col("_s").alias("source"), F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_b").alias("block"), _key(F.col("_epoch"), opts).alias("perm_key"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The taken rows of docs, a row for every copy, columns as they came."""
    opts = OPTIONS | options
    ends = _ends(_narrow(docs, opts), opts)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = row.select("_row", *_identity(F.col("_row.doc_id"), F.col("_row.source"), F.col("_row.text"), opts["block"]))
    return _taken(row, ends, opts).select("_row.*")


def _identity(doc_id: Column, source: Column, text: Column, block: int) -> list[Column]:
    i = doc_id.cast("long")
    return [i.alias("_id"), source.alias("_s"), F.xxhash64(text).alias("_h"), F.coalesce(((i - F.pmod(i, F.lit(block))) / block), F.lit(-(2.0**53))).cast("long").alias("_b")]


def _narrow(docs: DataFrame, opts: dict) -> DataFrame:
    return _store.keep(docs.select(*_identity(F.col("`doc_id`"), F.col("`source`"), F.col("`text`"), opts["block"]), token_count().alias("_n")), "tokens")


def _key(epoch: Column, opts: dict) -> Column:
    """The keyed hash that orders the blocks of an epoch."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(opts["seed"])), epoch.cast("string"), F.coalesce(F.col("_s"), F.lit("")), F.col("_b").cast("string"))), 1, 16)


def _place(opts: dict) -> Column:
    """Where a row stands in the last, partial epoch of its source."""
    return F.struct(_key(F.col("_whole"), opts).alias("k"), F.col("_b").alias("b"), F.coalesce(F.col("_id"), F.lit(-(2**63))).alias("i"), F.col("_h").alias("h"))


def _taken(rows: DataFrame, ends: DataFrame, opts: dict) -> DataFrame:
    """A row of `rows` for each epoch that takes it, as _epoch."""
    last = F.when(_place(opts) < F.col("_end"), F.col("_whole")).otherwise(F.col("_whole") - 1)
    joined = rows.join(ends, F.col("_s").eqNullSafe(F.col("_s2"))).withColumn("_last", last).where("_last >= 0")
    return joined.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))


def _ends(narrow: DataFrame, opts: dict) -> DataFrame:
    """(_s2, _whole, _end): per source the number of whole epochs and the place in the next one before which rows are taken."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("_s").agg(F.sum("_n").alias("n")).where("n > 0").collect()
    rows, _ = _plan(sorted(((r["_s"], r["n"]) for r in totals), key=lambda x: (x[0] is not None, x[0] or "")), opts["budget"], opts["entropy"], opts["repeats"])
    given = _few(spark, [(r["source"], r["budget"] // r["tokens"], r["budget"] % r["tokens"]) for r in rows], "_s2 string, _whole long, _rest long")
    placed = narrow.join(given, F.col("_s").eqNullSafe(F.col("_s2"))).withColumn("_at", _place(opts)).withColumn("_range", F.substring("_at.k", 1, 3))
    sums = placed.groupBy("_s2", "_range", "_rest").agg(F.sum("_n").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s2").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the range in which the rest runs out; the first place there that has all of the rest before it is the end
    last = before.where("_before <= _rest and _before + _sum >= _rest").groupBy("_s2").agg(F.min(F.struct("_range", "_before")).alias("_l")).select(F.col("_s2").alias("_s3"), F.col("_l._range").alias("_r3"), F.col("_l._before").alias("_b3"))
    inside = placed.join(last, F.col("_s2").eqNullSafe(F.col("_s3")) & (F.col("_range") == F.col("_r3"))).groupBy("_s2", "_rest", "_b3", "_at").agg(F.sum("_n").alias("_n"))
    run = inside.withColumn("_sofar", F.col("_b3") + F.coalesce(F.sum("_n").over(Window.partitionBy("_s2").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = run.where("_sofar >= _rest").groupBy("_s2").agg(F.min("_at").alias("_first")).select(F.col("_s2").alias("_s4"), "_first")
    # none in that range: the end is the beginning of the next range
    beyond = F.struct(F.concat(F.coalesce(F.col("_r3"), F.lit("")), F.lit("g")).alias("k"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("h"))
    out = given.join(last, F.col("_s2").eqNullSafe(F.col("_s3")), "left").join(end, F.col("_s2").eqNullSafe(F.col("_s4")), "left")
    out = out.select("_s2", "_whole", F.coalesce("_first", beyond).alias("_end"))
    return _few(spark, out.collect(), out.schema)  # as many rows as sources


def _few(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A table of the driver's, broadcast if it is small: joined by source it would put all rows of a hot source in one task."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


#: DuckDB: the bisection folds over a list, the epochs are a running sum.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n FROM documents
), s AS (
  SELECT source, sum(n)::BIGINT AS n, sum(sum(n)) OVER ()::BIGINT AS total, (sum(n) / sum(sum(n)) OVER ())::DOUBLE AS p FROM t GROUP BY source HAVING sum(n) > 0
), l AS (
  SELECT list(p) AS ps, @ENTROPY@ * ln(count(*)) AS goal FROM s
), bis AS (
  SELECT ps, CASE WHEN list_sum(list_transform(ps, lambda p: -p * ln(p))) >= goal THEN {'lo': 1.0::DOUBLE, 'hi': 1.0::DOUBLE} ELSE
    list_reduce(list_transform(range(60), lambda i: {'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}), lambda acc, x: CASE WHEN
      -list_sum(list_transform(ps, lambda p: pow(p, (acc.lo + acc.hi) / 2) / list_sum(list_transform(ps, lambda q: pow(q, (acc.lo + acc.hi) / 2))) * ln(pow(p, (acc.lo + acc.hi) / 2) / list_sum(list_transform(ps, lambda q: pow(q, (acc.lo + acc.hi) / 2)))))) >= goal
      THEN {'lo': (acc.lo + acc.hi) / 2, 'hi': acc.hi} ELSE {'lo': acc.lo, 'hi': (acc.lo + acc.hi) / 2} END, {'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}) END AS r FROM l
), w AS (
  SELECT source, n, floor(total * (pow(p, r.lo) / list_sum(list_transform(ps, lambda q: pow(q, r.lo)))))::BIGINT AS budget FROM s, bis
), e AS (
  SELECT t.doc_id, t.source, t.n AS n_tokens, unnest(range(0, (budget // w.n) + 1)) AS epoch, budget // w.n AS whole, budget % w.n AS rest, CAST(floor(doc_id / @BLOCK@) AS BIGINT) AS block FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source
), k AS (
  SELECT *, substring(md5(concat_ws(':', '@SEED@', epoch, coalesce(source, ''), block)), 1, 16) AS perm_key FROM e
), r AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY perm_key, block, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM k
)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, epoch::BIGINT AS epoch, block, perm_key FROM r WHERE epoch < whole OR sofar < rest
""".replace("@ENTROPY@", repr(ENTROPY)).replace("@BLOCK@", str(BLOCK)).replace("@SEED@", str(SEED))
