"""Scoring proposed step sequences: gold orders, projections, equivalence, selection, order, validity and next steps.

Sequences are tables (item, pos, method_id).  Only what depends on the order of work (breaking cycles, the least
topological order, matchings) runs as grouped pandas functions, one small graph or item at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.functions import kernels

# Steps that only keep books, operations that join everything, and the buckets of positions.
BOOKKEEPING = ["multiqc", "dumpsoftwareversions", "custom_dumpsoftwareversions", "softwareversions"]
BRIDGING: list[str] = ["op:operation_2409", "op:operation_0335"]


def gold_orders(charts: DataFrame, exclude: Iterable[str] = BOOKKEEPING) -> DataFrame:
    """(item, text) flow charts to (item, pos, step): cycles broken in rank order, then the least order by name."""
    drop = {x.lower() for x in exclude}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for item, text in zip(pdf["item"], pdf["text"], strict=True):
            order = [s for s in kernels.smallest_order(kernels.break_cycles(kernels.process_edges(text or ""))) if s.lower() not in drop]
            rows += [(item, k, s) for k, s in enumerate(order)]
        return pd.DataFrame(rows, columns=["item", "pos", "step"])

    return charts.select(F.col("item").cast("string"), "text").mapInPandas(lambda it: (run(x) for x in it), "item string, pos int, step string")


def gold_edges(charts: DataFrame, exclude: Iterable[str] = BOOKKEEPING) -> DataFrame:
    """(item, a, b): the acyclic precedences of each chart, without those that touch a bookkeeping step."""
    drop = {x.lower() for x in exclude}

    def run(it):
        for pdf in it:
            rows = [(i, a, b) for i, t in zip(pdf["item"], pdf["text"], strict=True) for a, b in kernels.break_cycles(kernels.process_edges(t or "")) if not {a.lower(), b.lower()} & drop]
            yield pd.DataFrame(rows, columns=["item", "a", "b"])

    return charts.select(F.col("item").cast("string"), "text").mapInPandas(run, "item string, a string, b string")


def break_cycles(edges: DataFrame) -> DataFrame:
    """(grp, rank, a, b) edges to the acyclic (grp, a, b) of each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = kernels.break_cycles(list(zip(pdf["rank"], pdf["a"], pdf["b"], strict=True)))
        return pd.DataFrame([(pdf["grp"].iloc[0], a, b) for a, b in kept], columns=["grp", "a", "b"])

    return edges.select("grp", F.col("rank").cast("long"), "a", "b").groupBy("grp").applyInPandas(run, "grp string, a string, b string")


def project_sequence(steps: DataFrame, modules: DataFrame) -> DataFrame:
    """(item, pos, step) to methods by (step, method_id), each where it comes first."""
    x = steps.join(modules, "step").groupBy("item", "method_id").agg(F.min("pos").alias("at"))
    return x.select("item", (F.row_number().over(Window.partitionBy("item").orderBy("at", "method_id")) - 1).alias("pos"), "method_id")


def project_edges(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Precedences of methods, without those that also hold the other way, and the number of these per item."""
    a, b = modules.select(F.col("step").alias("a"), F.col("method_id").alias("from_id")), modules.select(F.col("step").alias("b"), F.col("method_id").alias("to_id"))
    x = edges.join(a, "a").join(b, "b").where("from_id <> to_id").select("item", "from_id", "to_id").distinct()
    back = x.select("item", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return x.join(back, ["item", "from_id", "to_id"], "left_anti"), x.join(back, ["item", "from_id", "to_id"], "left_semi").groupBy("item").agg(F.count("*").alias("contradictions"))


def equivalence_classes(operations: DataFrame, inputs: DataFrame, bridging: Iterable[str] = BRIDGING) -> DataFrame:
    """(op, data, method_id): methods with a common operation that isn't a bridging one, and a common input, are equivalent.
    One row per method and class; the pairs are not made."""
    ops = operations.select("method_id", "op").where(~F.col("op").isin(list(bridging))).distinct()
    return ops.join(inputs.select("method_id", "data").distinct(), "method_id").select("op", "data", "method_id")


def class_sizes(classes: DataFrame) -> DataFrame:
    """(op, data, n_methods, first_method) of the classes that make two methods equivalent."""
    return classes.groupBy("op", "data").agg(F.count("*").alias("n_methods"), F.min("method_id").alias("first_method")).where("n_methods > 1")


def equivalents_of(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(a, b), a <> b: the methods equivalent to each of some (method_id) ones, for which alone pairs are made."""
    mine = classes.join(methods.select("method_id").distinct(), "method_id", "left_semi").select("op", "data", F.col("method_id").alias("a"))
    return mine.join(classes.select("op", "data", F.col("method_id").alias("b")), ["op", "data"]).where("a <> b").select("a", "b").distinct()


def matched(gold: DataFrame, predicted: DataFrame, same: DataFrame) -> DataFrame:
    """(item, gold_pos, pred_pos) of a largest matching per item; ``same`` holds equivalent (a, b)."""
    near = gold.select("item", F.col("method_id").alias("a")).join(same.select("a", "b").union(same.select("b", "a")), "a")
    return _matching(gold, predicted, near.join(predicted.select("item", F.col("method_id").alias("b")), ["item", "b"]))


def matched_by_class(gold: DataFrame, predicted: DataFrame, operations: DataFrame, inputs: DataFrame, bridging: Iterable[str] = BRIDGING) -> DataFrame:
    """``matched`` by ``equivalence_classes``: only pairs within an item are made, as its methods meet on the classes that
    they belong to."""
    used = gold.select("method_id").union(predicted.select("method_id")).distinct()
    classes = equivalence_classes(operations, inputs, bridging).join(used, "method_id", "left_semi")
    of = lambda df, n: df.select("item", "method_id").distinct().join(classes, "method_id").select("item", "op", "data", F.col("method_id").alias(n))
    return _matching(gold, predicted, of(gold, "a").join(of(predicted, "b"), ["item", "op", "data"]).where("a <> b"))


def _matching(gold: DataFrame, predicted: DataFrame, near: DataFrame) -> DataFrame:
    near = near.groupBy("item").agg(F.collect_set(F.struct("a", "b")).alias("same"))
    listed = lambda df, n: df.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "method_id"))), lambda s: s["method_id"]).alias(n))
    rows = listed(gold, "gold").join(listed(predicted, "pred"), "item").join(near, "item", "left")

    def run(it):
        for pdf in it:
            out = []
            for item, g, p, s in zip(pdf["item"], pdf["gold"], pdf["pred"], pdf["same"], strict=True):
                pairs = {(x["a"], x["b"]) for x in s} if s is not None else set()
                out += [(item, i, j) for i, j in kernels.match_steps(list(g), list(p), pairs).items()]
            yield pd.DataFrame(out, columns=["item", "gold_pos", "pred_pos"])

    return rows.mapInPandas(run, "item string, gold_pos int, pred_pos int")


def selection(gold: DataFrame, predicted: DataFrame, hits: DataFrame) -> DataFrame:
    """(item, precision, recall, f1); 0 for an empty prediction, null for an empty gold sequence."""
    n = lambda df, c: df.groupBy("item").agg(F.count_distinct("method_id").alias(c))
    x = n(gold, "n_gold").join(n(predicted, "n_pred"), "item", "left").join(hits.groupBy("item").agg(F.count("*").alias("n_hit")), "item", "left").na.fill(0)
    p = F.when(F.col("n_pred") > 0, F.col("n_hit") / F.col("n_pred")).otherwise(0.0)
    r = F.col("n_hit") / F.col("n_gold")
    x = x.withColumn("precision", p).withColumn("recall", r)
    return x.select("item", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


def identity_hits(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return gold.select("item", "method_id").distinct().join(predicted.select("item", "method_id").distinct(), ["item", "method_id"])


def sequencing(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(item, n_edges, n_kept, share) of the precedences with both ends placed, (item, method_id, pos), that are in order."""
    a, b = placed.select("item", F.col("method_id").alias("from_id"), F.col("pos").alias("pa")), placed.select("item", F.col("method_id").alias("to_id"), F.col("pos").alias("pb"))
    x = edges.join(a, ["item", "from_id"]).join(b, ["item", "to_id"])
    return x.groupBy("item").agg(F.count("*").alias("n_edges"), F.count_if(F.col("pa") < F.col("pb")).alias("n_kept")).withColumn("share", F.col("n_kept") / F.col("n_edges"))


def validity(sequence: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(item, pos, method_id, state): VALID if an earlier step writes one of the step's inputs, BROKEN if none does but a
    later one (that doesn't read it itself) would, UNKNOWN otherwise."""
    io = lambda df: df.select("method_id", F.col("data")).distinct()
    writes = sequence.join(io(outputs), "method_id")
    net = writes.join(io(inputs), ["method_id", "data"], "left_anti")
    first = writes.groupBy("item", "data").agg(F.min("pos").alias("first"))
    last = net.groupBy("item", "data").agg(F.max("pos").alias("last"))
    needs = sequence.join(io(inputs), "method_id").join(first, ["item", "data"], "left").join(last, ["item", "data"], "left")
    x = needs.groupBy("item", "pos", "method_id").agg(F.max(F.coalesce(F.col("first") < F.col("pos"), F.lit(False))).alias("before"), F.max(F.coalesce(F.col("last") > F.col("pos"), F.lit(False))).alias("after"))
    x = sequence.join(x, ["item", "pos", "method_id"], "left")
    return x.select("item", "pos", "method_id", F.when(F.col("before"), "VALID").when(F.col("after"), "BROKEN").otherwise("UNKNOWN").alias("state"))


def position_bucket(pos):
    return F.when(pos == 0, "0").when(pos <= 2, "1-2").when(pos <= 5, "3-5").otherwise("6+")


def next_step_hits(answers: DataFrame, k: int = 5) -> DataFrame:
    """(item, pos, gold, ranked) to those and bucket, top1 and topk."""
    ranked = F.array_distinct("ranked")
    return answers.select("*", position_bucket(F.col("pos")).alias("bucket"), F.coalesce(F.get(ranked, F.lit(0)) == F.col("gold"), F.lit(False)).alias("top1"), F.array_contains(F.slice(ranked, 1, k), F.col("gold")).alias("topk"))


def next_step_by_bucket(hits: DataFrame) -> DataFrame:
    return hits.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("top1").cast("double")).alias("top1"), F.avg(F.col("topk").cast("double")).alias("topk"))


def next_step_headline(hits: DataFrame) -> DataFrame:
    """One row: the mean of the buckets' means without the first bucket, and the pooled mean of all positions."""
    macro = next_step_by_bucket(hits).where("bucket <> '0'").agg(F.avg("top1").alias("macro_top1"), F.avg("topk").alias("macro_topk"))
    return macro.crossJoin(hits.agg(F.count("*").alias("n"), F.avg(F.col("top1").cast("double")).alias("pooled_top1")))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row over (task, error, answer, gold_resolved, score) results; means leave nulls out."""
    ok = F.col("error").isNull() & F.col("gold_resolved")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.count_if(F.col("error").isNull() & F.col("answer").isNull()).alias("n_unparsed"),
        F.count_if(F.col("error").isNull() & (F.size("answer") == 0)).alias("n_empty"),
        F.count_if(F.col("error").isNull() & ~F.col("gold_resolved")).alias("n_gold_unresolved"),
        F.count_if(ok & (F.col("task") == "whole")).alias("n_whole"),
        F.count_if(ok & (F.col("task") == "next")).alias("n_next"),
        F.avg(F.when(ok, F.col("score"))).alias("mean_score"),
    )


def modal_sequence(sequences: DataFrame) -> DataFrame:
    """The most frequent array ``seq``; of equals, the least."""
    return sequences.groupBy("seq").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "seq").limit(1)


def typical_length(sequences: DataFrame) -> DataFrame:
    """One row: the mean length, rounded half to even, at least 1; 3 without sequences."""
    return sequences.agg(F.coalesce(F.greatest(F.lit(1), F.bround(F.avg(F.size("seq")), 0).cast("int")), F.lit(3)).alias("length"))


def prefix_items(sequence: DataFrame) -> DataFrame:
    """(item, pos, given, gold): every position after the first as a next-step question, unless its answer is already given."""
    w = Window.partitionBy("item").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = sequence.withColumn("given", F.collect_list("method_id").over(w)).where("size(given) > 0")
    return x.where(~F.array_contains("given", F.col("method_id"))).select("item", "pos", "given", F.col("method_id").alias("gold"))


def name_candidates(name, aliases: dict[str, str] | None = None):
    """The ids that a name may stand for, in order: as it is, by its alias, with words joined, with words hyphenated."""
    low = F.lower(F.trim(name))
    spaced = F.trim(F.regexp_replace(low, r"[\s_-]+", " "))
    alias = F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), spaced) if aliases else F.lit(None).cast("string")
    c = F.array(low, alias, F.replace(spaced, F.lit(" "), F.lit("")), F.replace(spaced, F.lit(" "), F.lit("-")))
    return F.array_distinct(F.array_compact(c))


def resolve_names(names: DataFrame, methods: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(item, pos, name) to (item, pos, name, method_id): the first candidate that is a method, null where none is."""
    tries = names.select("item", "pos", "name", F.posexplode(name_candidates(F.col("name"), aliases)).alias("k", "cand"))
    known = methods.select(F.regexp_replace("id", "^m:", "").alias("cand"), F.col("id").alias("method_id"))
    hit = tries.join(known, "cand").groupBy("item", "pos").agg(F.min_by("method_id", "k").alias("method_id"))
    return names.join(hit, ["item", "pos"], "left").select("item", "pos", "name", "method_id")


def oracle(entity: DataFrame, rel: DataFrame) -> dict[str, DataFrame]:
    """Lookups for scoring: methods, modules (first method by id, and how many), operations, inputs and outputs (typed data)."""
    from lattix.operators.traverse import members, of_kind

    method = of_kind(entity, "Method")
    wraps = members(of_kind(rel, "WRAPS"), "to_id", method).where(F.col("from_id").startswith("mod:"))
    modules = wraps.groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("method_id"), F.count_distinct("to_id").alias("n_methods"))
    data = lambda kind: of_kind(rel, kind).where(F.col("to_id").startswith("data:")).select(F.col("from_id").alias("method_id"), F.col("to_id").alias("data")).distinct()
    return {
        "methods": method.select(F.col("id").alias("method_id")),
        "modules": modules,
        "operations": of_kind(rel, "PERFORMS").select(F.col("from_id").alias("method_id"), F.col("to_id").alias("op")).distinct(),
        "inputs": data("INPUT"),
        "outputs": data("OUTPUT"),
    }


def oracle_coverage(lookups: dict[str, DataFrame], steps: DataFrame) -> DataFrame:
    """One row: how many of the distinct steps have a method, and how many of those methods have operations, inputs, outputs."""
    s = steps.select("step").distinct().join(lookups["modules"], "step", "left")
    for n in ("operations", "inputs", "outputs"):
        s = s.join(lookups[n].select("method_id").distinct().withColumn(n, F.lit(True)), "method_id", "left")
    have = lambda c: F.count_distinct(F.when(F.col(c), F.col("method_id"))).alias(f"with_{c}")
    return s.agg(F.count("*").alias("n_steps"), F.count("method_id").alias("n_resolved"), F.count_if(F.col("n_methods") > 1).alias("n_multi_wrapped"), have("operations"), have("inputs"), have("outputs"))
