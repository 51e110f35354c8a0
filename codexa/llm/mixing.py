"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents and target weight w gets the rate ``size * w / sum of weights / n``. A hash of seed and id gives
each document a number u from 0 to below 1; the document's count is the smallest k with P(Poisson(rate) <= k) > u. A rate
above MAX_RATE is split into equal parts of at most MAX_RATE, each with a hash of its own, whose counts add up to
Poisson(rate). The document is exploded by its count, and the copies are put in the order of a second hash over the whole
corpus: as that hash is uniform, its ranges are known beforehand, so copies go to their range at once and are sorted there.

The rates come from one pre-aggregated count for each source, written to the shared folder. Up to MAX_BROADCAST sources
they are broadcast, else joined by source, which adaptive execution splits where a source is hot; sources beyond the
weights' list get `default`.

Defined results: a null source is a source of its own; a null text is copied like any other, and texts of any length are;
a null id hashes as an empty string; rows of equal id get equal counts, and lie side by side ordered by text; a weight of 0
drops a source; an empty table gives an empty result. All columns stay. Columns that are added get underscores in front
where the table has their name already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

SEED = 2024
HASH_BITS = 52
#: The hot source gets no more than the others; two sources are favoured.
WEIGHTS = {"src1": 2.0, "src2": 1.5}
DEFAULT = 1.0
#: Documents aimed at, as a multiple of those there are.
SIZE = 1.0
#: Rates above this are split into equal parts that are drawn on their own, to keep the tables of probabilities short.
MAX_RATE = 32.0
#: Sources whose rates (about 1 kB each) are broadcast.
MAX_BROADCAST = 20_000


def hash_number(*parts: Column) -> Column:
    """52 bits of md5 over the parts as text, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], default: float, size: float) -> DataFrame:
    """source, parts and cdf: the draws for each document, and P(Poisson <= k) for k = 0, 1, ... of one draw, as far as it grows."""
    weight = F.lit(default)
    for source, w in weights.items():
        weight = F.when(F.col("s") == source, F.lit(float(w))).otherwise(weight)
    counted = docs.groupBy(F.coalesce(F.col("source"), F.lit("\0")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("w", weight)
    total = counted.agg(F.sum("n").alias("all"), F.sum("w").alias("sum"))  # one row
    rate = F.lit(float(size)) * F.col("all") * F.col("w") / F.col("sum") / F.col("n")
    rows = counted.join(F.broadcast(total)).withColumn("rate", rate)
    rows = rows.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
    rows = rows.withColumn("rate", F.col("rate") / F.col("parts"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("a"))

    def step(s, k):
        p = F.when(k == 0, F.exp(-F.col("rate"))).otherwise(s.p * F.col("rate") / k)
        return F.struct(p.alias("p"), (s.c + p).alias("c"), F.concat(s.a, F.array(s.c + p)).alias("a"))

    cdf = F.aggregate(F.sequence(F.lit(0), F.lit(120)), zero, step, lambda s: s.a)
    return rows.select("s", "parts", F.array_distinct(cdf).alias("cdf"))


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front as far as they are taken."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name in held:
            name = "_" + name
        held.add(name)
        out.append(name)
    return out


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT, size: float = SIZE, seed: int = SEED) -> DataFrame:
    """The columns of docs, with copy (from 0), copies and training_order, in that order."""
    own = docs.columns
    copy, copies, order, source, parts, cdf, name = free_names(own, "copy", "copies", "training_order", "_source", "_parts", "_cdf", "_name")
    table = Scratch(docs.sparkSession).keep(rates(docs, weights, default, size).toDF(source, parts, cdf), "rates")
    table = F.broadcast(table) if table.count() <= MAX_BROADCAST else table
    rows = docs.withColumn(source, F.coalesce(F.col("source"), F.lit("\0"))).join(table, source)
    rows = rows.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = lambda *key: F.size(F.filter(cdf, lambda c: c <= hash_number(F.lit(str(seed)), *key, F.col(name)) / F.lit(float(1 << HASH_BITS))))
    more = F.aggregate(F.sequence(F.lit(2), F.col(parts)), F.lit(0), lambda n, i: n + drawn(F.lit("part"), i.cast("string")))
    rows = rows.withColumn(copies, drawn() + F.when(F.col(parts) > 1, more).otherwise(0))
    rows = rows.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    rows = rows.withColumn(order, hash_number(F.lit(str(seed)), F.lit("order"), F.col(name), F.col(copy).cast("string")))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(*own, copy, copies, order).repartitionById(ranges, F.floor(F.col(order) / F.lit(float(-(-(1 << HASH_BITS) // ranges)))).cast("int"))
    return rows.sortWithinPartitions(order, "doc_id", copy, *["text"] * ("text" in own))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (SELECT coalesce(source, chr(0)) AS s, count(*) AS n, CASE coalesce(source, chr(0)) WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM documents GROUP BY source),
full_rate AS (SELECT s, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n) / n AS r FROM n),
rate AS (SELECT s, greatest(ceil(r / 32.0::DOUBLE), 1)::INT AS parts, r / greatest(ceil(r / 32.0::DOUBLE), 1) AS r FROM full_rate),
p AS (SELECT s, k, exp(k * ln(r) - r - lgamma(k + 1)) AS p FROM rate, range(0, 121) AS t(k)),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM p),
d AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS name, row_number() OVER () AS id FROM documents),
part AS (SELECT id, name, s, unnest(range(1, parts + 1)) AS i FROM d JOIN rate ON s = coalesce(source, chr(0))),
u AS (SELECT id, s, i, ('0x' || substr(md5('2024:' || CASE WHEN i > 1 THEN 'part:' || i || ':' ELSE '' END || name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM part),
counted AS (SELECT u.id, count(*) FILTER (WHERE c <= u) AS copies FROM u JOIN cdf USING (s) GROUP BY u.id)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies::INT AS copies,
  ('0x' || substr(md5('2024:order:' || name || ':' || copy), 1, 13))::BIGINT AS training_order
FROM (SELECT d.*, copies, unnest(range(0, copies)) AS copy FROM d JOIN counted USING (id))
"""
