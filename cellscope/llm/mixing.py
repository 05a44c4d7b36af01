"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

The mean repetition of a source is its target share of the output over its share of the input.
Every document draws its count by inverting the Poisson distribution at a uniform number hashed
from a seed and its id, is exploded into that many copies, and the copies are dealt into a
random global order by a second hash.

A mean above PART_MEAN is cut into equal parts, each with a draw of its own: the sum of
independent Poisson draws is the Poisson draw of the sum. So the table of a distribution never has
more than some eighty steps, and a document of very many copies is dealt over tasks part by part
before it is exploded.

Defined results: a null source is a source of its own; a null id hashes like the empty string;
rows with one id draw one count (each row is copied that often); text is carried unread; an empty
table gives an empty result; a source whose target weight is 0 (or missing where weights are
given) has mean 0 and leaves no copies. All columns of the input are kept; the two new ones are
``copy_no`` and ``mix_key``, with underscores before them where the input has such names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.shared import column, spool, unused

SEED = 20240607
#: The largest mean that one draw inverts.
PART_MEAN = 16.0
#: Parts of a document that one task explodes; copy numbers of a part go up from the part's number times NUMBERS.
PARTS, NUMBERS = 64, 1000
#: The rate table is broadcast up to this size, by its rows and the bytes of its names; beyond, the join is shuffled.
BROADCAST_BYTES, ROW_BYTES = 1 << 25, 1024


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(f"{salt}{seed}"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = 1.0) -> DataFrame:
    """(source, mean): counts by source are pre-aggregated; equal weights unless given.

    Means sum, over the documents, to ``rate`` times their number.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = F.lit(1.0)
    if weights is not None:
        w = F.lit(0.0)
        for name, x in sorted(weights.items()):
            w = F.when(F.col("source") == name, float(x)).otherwise(w)
    counts = counts.withColumn("w", w)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    mean = F.coalesce(F.try_divide(rate * F.col("all_n") * F.col("w"), F.col("all_w") * F.col("n")), F.lit(0.0))
    return counts.crossJoin(F.broadcast(total)).select("source", mean.alias("mean"))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k), k = 0.. far into the upper tail, for a mean of at most PART_MEAN."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    # terms: accumulate (log of the term, sum so far, array) over k
    start = F.struct((-mean).alias("l"), F.exp(-mean).alias("s"), F.array(F.exp(-mean)).alias("a"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["l"] + F.log(mean) - F.log(k.cast("double"))
        s = acc["s"] + F.exp(log)
        return F.struct(log.alias("l"), s.alias("s"), F.concat(acc["a"], F.array(s)).alias("a"))

    full = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["a"])
    return F.when(mean > 0, full).otherwise(F.array(F.lit(1.0)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def copy_numbers(doc_id: Column, cdf: Column, first: Column, last: Column, seed: int) -> Column:
    """The numbers of a document's copies from its parts first..last, as one array."""

    def of_part(part: Column) -> Column:
        count = _let(uniform(seed, "count", doc_id, part), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
        numbers = _let(count, lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
        return F.transform(numbers, lambda k: part * NUMBERS + k)

    return F.flatten(F.transform(F.sequence(first, last), of_part))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = 1.0, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """The columns of ``docs`` (doc_id and source among them) plus ``copy_no`` and ``mix_key``.

    The result is dealt to partitions by ranges of ``mix_key``, a random key for each copy, and
    sorted by it, so a hot source or a run of copies spreads evenly. Keys are uniform, so ranges
    are known without a look at the data. ``copy_no`` counts from 1 within a part; see NUMBERS.
    """
    spark = docs.sparkSession
    name = {k: unused(docs, k) for k in ("copy_no", "mix_key", "__source", "__cdf", "__parts", "__chunk")}
    cdf, parts, chunk = F.col(name["__cdf"]), F.col(name["__parts"]), F.col(name["__chunk"])
    rates = spool(source_rates(docs, weights, rate).withColumn("parts", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("mean") / PART_MEAN))), "rates")
    size = rates.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.coalesce("source", F.lit("")))).alias("bytes"), F.max("parts").alias("parts")).first()  # one row
    few = size["rows"] * ROW_BYTES + (size["bytes"] or 0) <= BROADCAST_BYTES
    table = rates.select(F.col("source").alias(name["__source"]), F.col("parts").alias(name["__parts"]), poisson_cdf(F.col("mean") / F.col("parts")).alias(name["__cdf"]))
    joined = docs.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(name["__source"])))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exploded(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.select(*[column(c) for c in docs.columns], F.explode(copy_numbers(F.col("doc_id"), cdf, first, last, seed)).alias(name["copy_no"]))

    zero = F.lit(0).cast("bigint")
    copies = exploded(joined.where(parts <= PARTS), zero, parts - 1)
    if (size["parts"] or 1) > PARTS:
        many = joined.where(parts > PARTS).withColumn(name["__chunk"], F.explode(F.sequence(zero, F.floor((parts - 1) / PARTS))))
        many = many.repartition(n, F.xxhash64("doc_id", name["__chunk"]))
        copies = copies.unionByName(exploded(many, chunk * PARTS, F.least(parts, (chunk + 1) * PARTS) - 1))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(name["copy_no"]).cast("string")))
    out = copies.withColumn(name["mix_key"], key)
    place = F.floor(F.conv(F.substring(F.col(name["mix_key"]), 1, 7), 16, 10).cast("bigint") * n / (1 << 28)).cast("int")
    return out.repartitionById(n, place).sortWithinPartitions(name["mix_key"])
