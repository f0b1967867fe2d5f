"""Mixing sources to target weights: Pareto order sampling after whole certain copies, native.

Every source gets a target by water filling: ``SHARE`` of all words, dealt by weight, none above
``CAP`` times the source's own size. A document is taken floor(target / size) times for certain. For
the rest of the target each document has an inclusion probability in proportion to its size,
``p = min(1, scale * size)``, where the scale makes the expected words the rest: the longest
documents may be certain, and the others share what is left. Documents are ranked by random odds over
inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in that order until the rest of the
target is met, so a sample has a fixed size in words, up to half a document. ``u`` comes from the
document's id, hence reruns agree.

The scale comes from the numbers of documents by size, which are summed before the shuffle. The cut
in each source's ranking is found without ordering the source: ranks fall into buckets whose sizes
are summed before the shuffle, running sums are taken over buckets, and only the one bucket that
holds the cut is ordered, about 1 / ``BUCKETS`` of the source. A hot source is thus never in one task.

Defined results: a null text has size 0, and documents of size 0 are taken 0 times; the null
source is a source of its own that comes last; equal ranks go by id, and rows that repeat an id by
size. Several such equal rows share one rank and are taken together or not at all. A null id is
ranked by its own hash. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.text import word_count
from loomgraph.plans.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Buckets of a source's ranking: the rows ordered at once are this fraction of a source.
BUCKETS = 1 << 16
#: Buckets that are summed together first: running sums are over BUCKETS / SPAN and SPAN rows.
SPAN = 1 << 8
#: Bits of the random number.
BITS = 52


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) by water filling; the rows are sources, not documents.

    Sources in the order of cap over weight are capped from the front; the level is the first at
    which the next one stays under its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.select(
        "source",
        "source_size",
        "weight",
        "cap",
        F.row_number().over(order).alias("turn"),
        (
            (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    met = F.min(fits).over(every)["level"]  # the first that fits, not the least level
    target = F.least(F.coalesce(met * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 2^BITS) from the seed and the id's text."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def inclusion_scales(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """(source, scale): least(1, scale * size) are probabilities whose expected words are the source's rest.

    Sizes are gone through from the largest: the first that isn't certain, given that all larger
    ones are, sets the scale. The rows ordered for a source are its distinct sizes. Sums are whole
    numbers, so they don't depend on the order.
    """
    n, size = F.col("n").cast("decimal(18,0)"), F.col("size").cast("decimal(10,0)")
    lengths = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    rests = per.select(F.col("source").alias("_source"), "rest")
    lengths = lengths.join(rests, lengths["source"].eqNullSafe(F.col("_source"))).drop("_source")
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))
    squares = F.sum((n * size * size).cast("decimal(38,0)")).over(upto).cast("double")
    steps = lengths.select("source", "size", left.alias("left"), squares.alias("squares")).where(F.col("left") * F.col("size") <= F.col("squares"))
    return steps.groupBy("source").agg(F.max_by(F.col("left") / F.col("squares"), "size").alias("scale"))


def _ranked(sizes: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """``sizes`` with what its source gets, its inclusion probability p, and its rank, bucket and full order.

    Sources are joined, not documents: the right side has a row for each source.
    """
    per = per.withColumnRenamed("source", "_source")
    out = sizes.join(per, sizes["source"].eqNullSafe(F.col("_source"))).drop("_source")
    out = out.withColumn("p", F.least(F.lit(1.0), F.coalesce(F.col("scale") * F.col("size"), F.lit(0.0))))
    u = (_draw(F.col("doc_id"), seed) + 0.5) / float(1 << BITS)
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    out = out.withColumn("q", F.coalesce(odds, F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.lit(float("inf")))))
    # the rank on (0, 1), where the cut is near the middle
    scaled = F.when(F.col("q") == float("inf"), F.lit(1.0)).otherwise(F.col("q") / (1 + F.col("q")))
    bucket = F.least(F.floor(scaled * BUCKETS), F.lit(BUCKETS - 1))
    place = F.struct("q", F.isnull("doc_id").alias("unnamed"), F.col("doc_id").alias("id"), F.col("size").alias("words"))
    return out.withColumn("bucket", bucket).withColumn("place", place)


def mixture_plan(sizes: DataFrame, scratch: Scratch, seed: str = "") -> DataFrame:
    """A row for each source: source_size, target, whole, rest, scale, and where its ranking is cut.

    ``sizes`` (doc_id, source, size) should be a written table, as it is read several times. Rows
    in a bucket before ``cut_bucket``, and those in it up to the place ``last``, are taken once more.
    """
    per = source_targets(sizes)
    ratio = F.col("target") / F.col("source_size")
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(F.lit(0)).cast("long"))
    per = scratch.save(per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    per = scratch.save(_by_source(per, inclusion_scales(sizes, per)), "scales")

    ranked = _ranked(sizes, per, seed)
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("limit"))
    filled = scratch.save(filled.withColumn("span", F.floor(F.col("bucket") / SPAN)), "buckets")
    # running sums over spans first, then over the buckets of the one span that holds the cut
    spans = filled.groupBy("source", "span").agg(F.sum("words").alias("words"), F.first("limit").alias("limit"))
    span = _cut(spans, "span", F.lit(0)).select(F.col("source").alias("_source"), F.col("span").alias("_span"), F.col("before").alias("start"))
    inside = filled.join(span, filled["source"].eqNullSafe(F.col("_source")) & (F.col("span") == F.col("_span")))
    cut = _cut(inside, "bucket", F.col("start")).select("source", F.col("bucket").alias("cut_bucket"), F.col("before").alias("cut_before"))
    per = scratch.save(_by_source(per, cut), "cuts")

    near = _ranked(sizes, per, seed).where("bucket = cut_bucket")
    order = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.col("cut_before") + F.sum("size").over(order)
    own = F.sum("size").over(Window.partitionBy("source", "place"))
    last = near.where("p > 0").withColumn("fits", so_far - own / 2 <= F.col("rest")).where("fits").groupBy("source").agg(F.max("place").alias("last"))
    return scratch.save(_by_source(per, last), "plan")


def _cut(rows: DataFrame, step: str, start: Column) -> DataFrame:
    """The rows of each source whose step takes its running sum over the limit, with the sum before them."""
    running = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", start + F.coalesce(F.sum("words").over(running), F.lit(0)))
    return rows.where("before <= limit and before + words > limit")


def _by_source(per: DataFrame, more: DataFrame) -> DataFrame:
    more = more.withColumnRenamed("source", "_source")
    return per.join(more, per["source"].eqNullSafe(F.col("_source")), "left").drop("_source")


def _copies(rows: DataFrame, plan: DataFrame, seed: str = "") -> DataFrame:
    """``rows`` (with doc_id, source, size) and the column copies."""
    out = _ranked(rows, plan, seed)
    before = F.col("bucket") < F.col("cut_bucket")
    at = (F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))
    extra = F.coalesce(before | at, F.lit(True)) & (F.col("p") > 0)
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long"))


def _sizes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame, scratch: Scratch, seed: str = "") -> DataFrame:
    """doc_id, size, source, source_size, target, p, copies and taken (copies times size)."""
    sizes = _sizes(docs, scratch)
    out = _copies(sizes, mixture_plan(sizes, scratch, seed), seed)
    return out.select("doc_id", "size", "source", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are decided where they are scanned, from their source's row of the plan: texts aren't shuffled.
    """
    plan = mixture_plan(_sizes(docs, scratch), scratch)
    carried = F.struct(*docs.columns).alias("_row")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), carried)
    taken = _copies(rows, plan).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return taken.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


#: The same rows in DuckDB: each source is ordered as a whole.
MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, {CAP} * source_size AS cap FROM per),
levels AS (
  SELECT *, row_number() OVER w AS turn, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM placed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
met AS (SELECT arg_min(level, turn) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, least(coalesce(m.level * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM levels, met m),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
lengths AS (SELECT source, size, count(*) AS n FROM sizes WHERE size > 0 GROUP BY source, size),
steps AS (
  SELECT l.source, l.size, r.rest - coalesce(sum(l.n * l.size) OVER (PARTITION BY l.source ORDER BY l.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
    CAST(sum(l.n::HUGEINT * l.size * l.size) OVER (PARTITION BY l.source ORDER BY l.size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS squares
  FROM lengths l JOIN rests r ON l.source IS NOT DISTINCT FROM r.source),
scales AS (SELECT source, arg_max(spare / squares, size) AS scale FROM steps WHERE spare * size <= squares GROUP BY source),
drawn AS (
  SELECT s.doc_id, s.size, r.*, least(1::DOUBLE, coalesce(c.scale * s.size, 0)) AS p,
    (CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, {BITS // 4}) AS BIGINT) + 0.5::DOUBLE) / {float(1 << BITS)}::DOUBLE AS u
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN scales c ON s.source IS NOT DISTINCT FROM c.source),
ranked AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) WHEN p >= 1 THEN 0 ELSE 'inf'::DOUBLE END AS q FROM drawn),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
    sum(size) OVER (PARTITION BY source, q, doc_id, size) AS own FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN p > 0 AND so_far - own / 2 <= rest THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM summed
"""
