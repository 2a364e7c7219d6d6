"""Mixing sources to target weights by Poisson replication, with built-in functions only.

A source's rate is the mean number of copies per document that brings its size to
its share of the target: rate = share * target / size, sizes in characters. Each
row draws a uniform number from a digest of seed and key and inverts the Poisson
distribution of its source's rate with it; rates above STEP are drawn as sums of
independent parts, so any rate is exact and none underflows. A row is exploded
into as many copies, and the copies are dealt out and sorted by a digest of seed,
key and copy: a global shuffle that a rerun after a lost executor repeats exactly.

Sizes are summed with partial aggregation. The table of rates has one row per
source; it is broadcast after its row count was checked (MOST_BROADCAST), else
copied SALTS times and joined on source and salt, so that a source with a third
of all rows is spread over SALTS tasks.

Defined cases: null and empty sources are sources of their own; a source whose
documents are all empty has size 0, gets rate 0 and is dropped; a null text has
size 0 and is mixed like any other row of its source; a null doc_id draws with an
empty key; rows repeating a doc_id draw alike; sources without a given weight get
weight 0 if weights are given; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import kept

SEED = 20
STEP = 64.0
SALTS = 32
MOST_BROADCAST = 20_000
HEX = 12  # digits of a digest that make a uniform number: 48 bits, exact in a double


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key's parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, up to where doubles tell no difference from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def longer(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, longer, lambda state: state["cdf"])


def rates(sizes: DataFrame, weights: dict[str | None, float] | None, power: float, target: int | None) -> DataFrame:
    """source, parts, cdf from source and size; each row draws `parts` times from `cdf` and adds up.

    Without weights a source's weight is its size to the given power.
    """
    if weights is None:
        raw = F.sqrt(F.col("size").cast("double")) if power == 0.5 else F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, raw).otherwise(0.0))
    weights_sum, sizes_sum = weighed.agg(F.sum("weight"), F.sum("size")).first()  # one row
    if not weights_sum:
        return sizes.select("source", F.lit(0.0).alias("rate"), F.lit(1).alias("parts"), F.array(F.lit(1.0)).alias("cdf"))
    wanted = float(sizes_sum if target is None else target)
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(weights_sum) * F.lit(wanted) / F.col("size")).otherwise(0.0)
    drawn = weighed.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    return drawn.select("source", "rate", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf"))


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    target: int | None = None,
    seed: int = SEED,
    marks: bool = True,
) -> DataFrame:
    """All columns of `docs` in global random order; with `marks`, `copy` (from 1) and `shuffle_key` are added or replaced.

    `target` is the size of the result in characters, by default that of `docs`.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sizes = kept(docs.groupBy("source").agg(F.sum(size).alias("size")), "source-sizes")
    table = rates(sizes, weights, power, target)
    added = ["copy", "shuffle_key"] if marks else []
    names = [f"r.`{c}`" for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r"))
    if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        matched = rows.join(F.broadcast(table), F.col("r.source").eqNullSafe(F.col("source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        key = F.pmod(F.xxhash64("r.doc_id"), F.lit(SALTS)).cast("int")
        matched = rows.withColumn("own", key).join(salted, F.col("r.source").eqNullSafe(F.col("source")) & (F.col("own") == F.col("salt")))
    key = F.coalesce(F.col("r.doc_id").cast("string"), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(str(seed)), key, part.cast("string")))
    count = F.aggregate(drawn, F.lit(0), lambda sofar, u: sofar + F.size(F.filter("cdf", lambda p: p <= u)))
    counted = matched.select("r", count.alias("n")).filter("n > 0")
    copies = counted.select("r", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}+"), F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    keyed = copies.withColumn("shuffle_key", place)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*names, *added)
