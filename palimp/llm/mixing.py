"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is the repetition rate its source
needs: target share x target size / size of the source. The draw inverts the distribution at a uniform number hashed
from (seed, doc_id), so it is the same on every run and for every partitioning. Copies are dealt over the cluster by a
hash of their own and put in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.llm.base import partitions, query, set_apart, table

#: A mean above this is drawn as the sum of several draws of equal smaller means, which keeps exp(-mean) exact.
LARGEST_MEAN = 32.0
#: The name under which sources without a weight of their own, and null, are taken together.
OTHER = "(other)"
#: Share of each source in the mixed data; 20 sources of very unequal size.
WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)} | {OTHER: 1.0}


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def repetition_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, source: str = "source") -> DataFrame:
    """class, n_docs, rate, parts, cdf for each source class of the weights that has documents.

    Rates are such that the expected number of copies is ``epochs`` times the number of documents and the expected shares
    are the weights, normalised over the classes present. ``cdf`` is the cumulative distribution of one of ``parts`` draws.
    The table has at most as many rows as there are weights.
    """
    shares = docs.sparkSession.createDataFrame(sorted(weights.items()), "class string, weight double")
    sizes = docs.groupBy(source_class(source, weights).alias("class")).agg(F.count("*").alias("n_docs"))
    present = sizes.join(F.broadcast(shares), "class")
    whole = Window.partitionBy(F.lit(1))  # over one row per weight
    rate = F.col("weight") * F.sum("n_docs").over(whole) * F.lit(float(epochs)) / (F.sum("weight").over(whole) * F.col("n_docs"))
    rates = present.withColumn("rate", rate)
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    # State: the probability and the cumulative probability of the last count, and all cumulative ones.
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(int(LARGEST_MEAN * 4 + 32))),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"),
            F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all"),
        ),
    )
    return rates.select("class", "n_docs", "rate", "parts", steps["all"].alias("cdf"))


def source_class(source: str, weights: dict[str, float]) -> Column:
    named = [k for k in sorted(weights) if k != OTHER]
    return F.when(F.col(source).isin(named), F.col(source)).otherwise(OTHER)


@set_apart("__class", "__parts", "__cdf", "__n")
def mix(
    docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: int = 7, key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The documents' columns, with ``copy`` (from 1) and ``order_key``: one row per copy, in an order shuffled over all.

    A source without a weight, and a null source, fall under "(other)"; where the weights have no such entry, or a weight
    is 0, there is no copy. A null id draws as empty text; rows that repeat an id draw the same count. An empty table
    gives no rows. Columns named copy or order_key are replaced; all others, clashing names included, stay as they are.
    """
    names = [n for n in docs.columns if n not in ("copy", "order_key")]
    rates = repetition_rates(docs, weights, epochs, source)
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    numbers = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda part: _uniform(F.lit(str(seed)), ident, part.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    rates = F.broadcast(rates.select(*[F.col(c).alias(f"__{c}") for c in ("class", "parts", "cdf")]))  # at most one row per weight
    counted = docs.select(*names).join(rates, source_class(source, weights) == F.col("__class")).withColumn("__n", drawn)
    copies = counted.where("__n > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), ident, F.col("copy").cast("string")))
    return copies.withColumn("order_key", order).repartition(partitions(docs), "order_key").sortWithinPartitions("order_key")


ORACLE = f"""
with w(class, weight) as (values {", ".join(f"('{k}', {v}::double)" for k, v in sorted(WEIGHTS.items()))}),
d as (select *, case when source in (select class from w where class <> '{OTHER}') then source else '{OTHER}' end as class from documents),
s as (select class, count(*) as n from d group by class), p as (select * from s join w using (class)),
t as (select sum(weight) as aw, sum(n) as an from p),
r as (select class, weight * an * 1.0::double / (aw * n) as rate from p, t),
q as (select class, rate, greatest(1, ceil(rate / {LARGEST_MEAN}::double))::int as parts from r),
m as (select class, parts, rate / parts as mean from q),
c as (with recursive c(class, k, p, c) as (
  select class, 0, exp(-mean), exp(-mean) from m
  union all select c.class, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from c join m using (class) where k < {int(LARGEST_MEAN * 4 + 32)}) select * from c),
u as (select d.*, m.parts, unnest(range(1, m.parts + 1)) as part from d join m using (class)),
v as (select *, ('0x' || substr(md5('7|' || doc_id || '|' || part), 1, 13))::bigint::double / {float(2**52)} as u from u),
k as (select v.doc_id, v.part, count(c.k) as n from v left join c on c.class = v.class and c.c <= v.u group by v.doc_id, v.part),
n as (select doc_id, sum(n)::int as n from k group by doc_id)
select doc_id, text, lang, source, n_chars, copy, md5('order 7|' || doc_id || '|' || copy) as order_key
from (select documents.*, unnest(range(1, n + 1))::int as copy from documents join n using (doc_id) where n > 0)
"""


@query("op7_poisson_mixing", ORACLE)
def op7(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)
