"""Mixing sources to target weights, by DataFrame operations only.

1. Targets: the sources share the total size by weight; a target stops at ``max_repeats`` times its source's size and
   what is over is shared again by weight, which is one water level over the sources.
2. Quotas: a source's documents fall into blocks by a hash: 4,096, or so many times sixteen more that a shard of
   ``shard_words`` takes at least four blocks.  Its quota in words is some whole passes over
   all blocks and a rest, drawn from the blocks in a permuted order; the block at the end of the rest is drawn in part,
   document by document, so every source's words equal its rounded target.
3. Splitting tree: the counts of drawn blocks per source are halved among output shards again and again; each split
   is a multivariate hypergeometric draw (one source after the other, by inverting the distribution function), so
   shards have equal numbers of blocks and the counts add up exactly.
4. Draws: a source's drawn blocks are permuted and dealt to the shards as disjoint runs of these lengths; inside a
   shard, documents are ordered by a hash.

Nothing is random: all draws come from hashes of the seed, so reruns agree.  No source or block passes through one
task; windows run over blocks of a source (four for each of the shards, or 4,096), over the documents of single blocks,
and over the list of sources, which the root of the tree holds in one row: some thousands of sources are well, millions
are not.

Defined results: a null text has size 0; null sources form one source, last in order; with no words at all every
target and taken figure is 0; documents of size 0 are never taken; repeated rows are drawn on their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import WORD, stored


def sizes(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, ord) of every document; a block holds the documents whose ``ord`` begins alike."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), h.alias("ord"))


def block_digits(words: int, shard_words: int) -> int:
    """Hexadecimal digits of a block's name: three, or as many as make blocks of a quarter of a shard."""
    return max(3, math.ceil(math.log(max(1.0, 4 * words / shard_words), 16)))


def targets(per_source: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) to those and rank, weight, target, quota, passes and rest."""
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    level_before = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    x = x.withColumn("full", F.col("cap") < level_before * F.col("weight"))
    x = x.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    x = x.withColumn("weight_full", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every))
    level = (F.col("total") - F.col("cap_full")) / F.nullif(F.col("all_weight") - F.col("weight_full"), F.lit(0))
    x = x.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0))))
    x = x.withColumn("quota", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("cap")))
    some = F.col("source_size") > 0
    x = x.withColumn("passes", F.when(some, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("long"))
    return x.select("source", "rank", "source_size", "target", "quota", "passes", (F.col("quota") - F.col("passes") * F.col("source_size")).alias("rest"))


def _ln_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among the ``marked`` ones, at the quantile ``u`` of the
    distribution (its terms beyond eight standard deviations are below double precision and left out)."""
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    sd = F.sqrt(F.when(n > 1, mean * (n - k) / n * (n - d) / (n - 1)).otherwise(0.0))
    low = F.greatest(drawn - (total - marked), F.floor(mean - 8 * sd - 2), F.lit(0)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + 8 * sd + 2)).cast("long")
    terms = F.transform(F.sequence(low, F.greatest(low, high)), lambda x: F.exp(_ln_choose(marked, x) + _ln_choose(total - marked, drawn - x) - _ln_choose(total, drawn)))
    at = F.aggregate(
        F.transform(F.array(terms), lambda p: F.struct(p.alias("p"), (F.aggregate(p, F.lit(0.0), lambda a, y: a + y) * u).alias("goal")))[0]["p"],
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("at"), u.alias("u")),
        lambda a, y: F.struct((a["sum"] + y).alias("sum"), F.when(a["sum"] < a["u"], a["at"] + 1).otherwise(a["at"]).alias("at"), a["u"].alias("u")),
        lambda a: a["at"],
    )
    return F.least(low + F.greatest(at, F.lit(0)), F.greatest(low, high))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def split_tree(units: DataFrame, levels: int, *, seed: int = 0) -> DataFrame:
    """(rank, units) to (rank, shard, units) for 2 ** levels shards; a source has rows for the shards that it is in."""
    nodes = units.select(F.lit(0).cast("long").alias("node"), "rank", F.col("units").cast("long").alias("units"))
    for level in range(levels):
        packed = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "units"))).alias("counts"), F.sum("units").alias("total"))
        start = F.struct(F.col("total").alias("total"), F.expr("total div 2").alias("drawn"), F.expr("cast(array() as array<struct<rank:int,units:bigint,left:bigint>>)").alias("out"), F.col("node").alias("node"))

        salt = F.lit(level)

        def step(a: Column, c: Column, salt: Column) -> Column:
            x = hypergeometric(a["total"], c["units"], a["drawn"], _uniform(F.lit(seed), salt, a["node"], c["rank"]))
            left = F.transform(F.array(x), lambda v: F.struct(c["rank"].alias("rank"), c["units"].alias("units"), v.alias("left")))
            return F.struct(
                (a["total"] - c["units"]).alias("total"), (a["drawn"] - left[0]["left"]).alias("drawn"), F.concat(a["out"], left).alias("out"), a["node"].alias("node")
            )

        split = packed.select("node", F.explode(F.aggregate("counts", start, lambda a, c: step(a, c, salt), lambda a: a["out"])).alias("c"))
        split = split.select("node", "c.rank", "c.units", "c.left")
        left = split.select((F.col("node") * 2).alias("node"), "rank", F.col("left").alias("units"))
        right = split.select((F.col("node") * 2 + 1).alias("node"), "rank", (F.col("units") - F.col("left")).alias("units"))
        nodes = stored(left.unionByName(right).where("units > 0"), "nodes")
    return nodes.select("rank", F.col("node").alias("shard"), "units")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, shard_words: int = 1 << 24, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and draws, an array of
    struct<shard, pass, words, position>.  There are as many shards, a power of two, as make about ``shard_words`` each."""
    sized = stored(sizes(docs, seed=seed), "sizes")
    digits = block_digits(sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shard_words)
    sized = sized.withColumn("block", F.substring("ord", 1, digits))
    per_block = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    plan = targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, max_repeats=max_repeats)
    plan = stored(plan, "plan")
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    levels = max(0, math.ceil(math.log2(max(1, total) / shard_words)))

    # the drawn blocks: passes over all, and those of the rest
    permuted = Window.partitionBy("rank").orderBy("block_order", "block")
    same = F.col("b.source").eqNullSafe(F.col("p.source"))
    blocks = per_block.alias("b").join(plan.alias("p"), same).select("p.*", "b.block", "b.words")
    blocks = blocks.withColumn("block_order", F.md5(F.concat_ws(":", "block", F.coalesce("source", F.lit("")), F.lit(str(seed))).cast("binary")))
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    within = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("words"))
    blocks = blocks.withColumn("within", within)
    drawn = F.when(F.col("within") > 0, F.col("passes") + 1).otherwise(F.col("passes"))
    units = blocks.where((drawn > 0) & (F.col("words") > 0)).select("rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), drawn)).alias("pass"))
    counts = units.groupBy("rank").agg(F.count("*").alias("units"))
    quotas = split_tree(counts, levels, seed=seed)
    upto = Window.partitionBy("rank").orderBy("shard")
    # a source's permuted units and the places where its shards begin, in one order: a unit is in the last shard begun
    starts = quotas.select("rank", (F.sum("units").over(upto) - F.col("units") + 1).alias("at"), F.lit(0).alias("unit"), "shard", F.lit(None).cast("string").alias("block"), F.lit(None).cast("long").alias("pass"))
    dealt = units.withColumn("at", F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block", "pass"), "block", "pass")).cast("long"))
    dealt = dealt.select("rank", "at", F.lit(1).alias("unit"), F.lit(None).cast("long").alias("shard"), "block", "pass")
    begun = Window.partitionBy("rank").orderBy("at", "unit").rowsBetween(Window.unboundedPreceding, 0)
    dealt = starts.unionByName(dealt).withColumn("shard", F.last("shard", ignorenulls=True).over(begun)).where("unit = 1")
    dealt = dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("units"))
    planned = stored(blocks.join(dealt, ["rank", "block"], "left").drop("block_order", "words", "before", "quota", "rest"), "blocks")

    # every document gets its block's draws; only documents of a block drawn in part need their order inside it
    whole_block = per_block.select("source", "block", "words")
    planned = planned.alias("x").join(whole_block.alias("w"), F.col("x.source").eqNullSafe(F.col("w.source")) & (F.col("x.block") == F.col("w.block"))).select("x.*", "w.words")
    with_plan = sized.alias("d").join(planned.alias("x"), F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d.block") == F.col("x.block")))
    with_plan = with_plan.select("d.doc_id", "d.source", "d.size", "d.ord", "d.block", "x.rank", "x.source_size", "x.target", "x.passes", "x.within", "x.words", "x.units")
    partial = (F.col("within") > 0) & (F.col("within") < F.col("words"))
    inside = Window.partitionBy("rank", "block").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = with_plan.where(partial).withColumn("doc_before", F.sum("size").over(inside) - F.col("size"))
    edge = edge.withColumn("last", F.least(F.greatest(F.col("within") - F.col("doc_before"), F.lit(0)), F.col("size"))).drop("doc_before")
    rest = with_plan.where(~partial).withColumn("last", F.when(F.col("within") > 0, F.col("size")).otherwise(F.lit(0)))
    out = rest.unionByName(edge)
    words = lambda u: F.when(u["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("last"))
    draws = F.transform(
        F.coalesce("units", F.expr("cast(array() as array<struct<pass:bigint,shard:bigint>>)")),
        lambda u: F.struct(u["shard"].alias("shard"), u["pass"].alias("pass"), words(u).cast("long").alias("words"), F.xxhash64(F.lit(seed), F.col("doc_id"), u["pass"]).alias("position")),
    )
    out = out.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))
    taken = F.col("passes") * F.col("size") + F.col("last")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "draws")


#: The same figures as SQL for DuckDB: one running sum per source in the permuted order.
TAKEN_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('0:' || coalesce(doc_id::varchar, 'null')) as ord
  from {docs}),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as rank from d group by source),
w as (select *, (1 + (rank - 1) % 3)::bigint as weight, 3 * source_size as cap from s),
b as (
  select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
         coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before
  from w window o as (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding)),
f as (select *, cap < (total - cap_before)::double / (all_weight - weight_before)::double * weight as is_full from b),
g as (select *, sum(case when is_full then cap else 0 end) over () as cap_full, sum(case when is_full then weight else 0 end) over () as weight_full from f),
t as (
  select source, source_size, cap,
         case when is_full then cap::double else coalesce((total - cap_full)::double / nullif(all_weight - weight_full, 0)::double * weight, 0) end as target
  from g),
q as (select *, least(floor(target + 0.5)::bigint, cap) as quota from t),
p as (select *, case when source_size > 0 then quota // source_size else 0 end as passes from q),
r as (
  select d.doc_id, d.size, p.source_size, p.target, p.passes, p.quota - p.passes * p.source_size as rest,
         sum(d.size) over (partition by d.source order by md5(substr(d.ord, 1, 3) || ':' || coalesce(d.source, '') || ':0'), substr(d.ord, 1, 3), d.ord, d.doc_id, d.size
                           rows between unbounded preceding and current row) - d.size as before
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size::bigint as source_size, target,
       (passes * size + least(greatest(rest - before, 0), size))::bigint as taken
from r
"""
