"""Running and rescoring evaluation items, baselines, and the manifest of a build of items."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import kernels
from lattix.operators import evalkit

WHOLE = "Goal: %s\nName the steps of a pipeline for it, in order, as a JSON list of tool names."
NEXT = "Goal: %s\nDone so far: %s\nName the next step, most likely first, as a JSON list of tool names."


def prompts(items: DataFrame) -> DataFrame:
    """Items with their ``prompt``."""
    given = F.concat_ws(", ", "given")
    return items.withColumn("prompt", F.when(F.col("task") == "whole", F.format_string(WHOLE, F.col("goal"))).otherwise(F.format_string(NEXT, F.col("goal"), given)))


def run_items(items: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """(id, task, raw, error) of calling ``answer(id, prompt)`` for every item; a failure is recorded, not raised."""

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, t, p in zip(pdf["id"], pdf["task"], pdf["prompt"], strict=True):
                try:
                    rows.append((i, t, answer(i, p), None))
                except Exception as e:  # noqa: BLE001  whatever an adapter raises becomes the row's error
                    rows.append((i, t, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "task", "raw", "error"])

    return prompts(items).select("id", "task", "prompt").mapInPandas(call, "id string, task string, raw string, error string")


def run_to_lines(items: DataFrame, answer: Callable[[str, str], str], path: str) -> int:
    """Answer items one by one, each written as a line of JSON before the next is asked, so that a run that breaks off loses
    nothing; items that the file has already are passed over.  The number of answers asked for."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    done = {json.loads(x)["id"] for x in target.read_text().splitlines() if x.strip()} if target.exists() else set()
    n = 0
    with target.open("a") as out:
        for r in prompts(items).select("id", "task", "prompt").orderBy("id").toLocalIterator():
            if r["id"] in done:
                continue
            try:
                raw, error = answer(r["id"], r["prompt"]), None
            except Exception as e:  # noqa: BLE001  whatever an adapter raises becomes the row's error
                raw, error = None, f"{type(e).__name__}: {e}"
            out.write(json.dumps({"id": r["id"], "task": r["task"], "raw": raw, "error": error}, sort_keys=True) + "\n")
            out.flush()
            n += 1
    return n


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, task, raw, error) rows of a file of answers."""
    return spark.read.schema("id string, task string, raw string, error string").json(path)


def read_clones(spark: SparkSession, root: str, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, outcomes) of the pipelines below a folder, by ``build_items``; one without a chart is dropped for that reason."""
    from lattix.sources.pipelines import read_charts, read_membership

    charts = read_charts(spark, root).select(F.col("pipeline").alias("item"), "text")
    sequences, outcomes = build_items(charts, modules)
    bare = read_membership(spark, root).select(F.col("pipeline").alias("item")).distinct().join(charts.select("item"), "item", "left_anti")
    bare = bare.select("item", F.lit("dropped").alias("status"), F.lit("no chart").alias("reason"), F.lit(0).cast("long").alias("n_items"))
    return sequences, outcomes.unionByName(bare)


def static(responses: dict[str, str]) -> Callable[[str, str], str]:
    """An adapter that replays answers by item id and fails without one."""
    return lambda item, prompt: responses[item]


def rescore(results: DataFrame, items: DataFrame, methods: DataFrame, aliases: dict[str, str] | None = None, k: int = 5) -> DataFrame:
    """(id, task, error, answer, unresolved, gold_resolved, f1, top1, topk) from stored raw answers.  A row counts as failed by
    its error, not by a missing answer; scores that don't apply are null."""
    from lattix.functions.text import parse_answer

    r = results.withColumn("names", F.when(F.col("error").isNull(), parse_answer("raw")))
    listed = r.select(F.col("id").alias("item"), F.posexplode("names").alias("pos", "name"))
    named = evalkit.resolve_names(listed, methods, aliases)
    per = named.groupBy("item").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("method_id").isNotNull(), F.struct("pos", "method_id")))), lambda s: s["method_id"])).alias("answer"),
        F.array_sort(F.collect_set(F.when(F.col("method_id").isNull(), F.col("name")))).alias("unresolved"),
    )
    none = F.array().cast("array<string>")
    x = r.select("id", "task", "error", "names").join(per.withColumnRenamed("item", "id"), "id", "left").join(items.select("id", "gold"), "id")
    x = x.withColumn("answer", F.when(F.col("names").isNotNull(), F.coalesce("answer", none))).withColumn("unresolved", F.coalesce("unresolved", none))
    gold = F.array_distinct(F.coalesce("gold.sequence", none))
    hit = F.size(F.array_intersect("answer", gold))
    f1 = F.when(F.col("answer").isNotNull() & (F.size(gold) > 0), 2 * hit / (F.size("answer") + F.size(gold)))
    whole, next_ = F.col("task") == "whole", F.col("task") == "next"
    known = methods.select(F.col("id").alias("__known")).distinct()
    x = x.join(known, F.col("gold.next") == F.col("__known"), "left").withColumn("gold_resolved", F.when(next_, F.col("__known").isNotNull()).otherwise(F.size(gold) > 0))
    return x.select(
        "id", "task", "error", "answer", "unresolved", "gold_resolved", F.when(whole, f1).alias("f1"),
        F.when(next_ & F.col("answer").isNotNull(), F.coalesce(F.get("answer", F.lit(0)) == F.col("gold.next"), F.lit(False))).alias("top1"),
        F.when(next_ & F.col("answer").isNotNull(), F.array_contains(F.slice("answer", 1, k), F.col("gold.next"))).alias("topk"),
    )


def as_answer(method_ids: list[str]) -> str:
    return json.dumps([m.removeprefix("m:") for m in method_ids])


def random_answer(method_ids: list[str], k: int, seed: int) -> str:
    """One fixed answer of ``k`` methods, drawn without replacement from the sorted ids."""
    return as_answer(random.Random(seed).sample(sorted(method_ids), min(k, len(method_ids))))


def build_items(charts: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, outcomes): gold sequences of methods (item, pos, method_id) of flow charts, and (item, status, reason) of each."""
    steps = evalkit.gold_orders(charts)
    sequences = evalkit.project_sequence(steps, modules)
    n = steps.groupBy("item").agg(F.count("*").alias("n_steps")).join(sequences.groupBy("item").agg(F.count("*").alias("n_methods")), "item", "left")
    x = charts.select(F.col("item").cast("string")).distinct().join(n, "item", "left")
    reason = F.when(F.col("n_steps").isNull(), "no steps").when(F.coalesce("n_methods", F.lit(0)) < 2, "fewer than two methods")
    outcomes = x.select("item", F.when(reason.isNull(), "used").otherwise("dropped").alias("status"), reason.alias("reason"), F.coalesce("n_methods", F.lit(0)).alias("n_items"))
    return sequences.join(outcomes.where("status = 'used'").select("item"), "item", "left_semi"), outcomes


def build_manifest(outcomes: DataFrame) -> DataFrame:
    """One row (n_used, n_dropped, n_items); a dropped row without a reason is an error."""
    bad = F.count_if((F.col("status") == "dropped") & (F.coalesce("reason", F.lit("")) == ""))
    x = outcomes.agg(F.count_if(F.col("status") == "used").alias("n_used"), F.count_if(F.col("status") == "dropped").alias("n_dropped"), F.coalesce(F.sum(F.when(F.col("status") == "used", F.col("n_items"))), F.lit(0)).alias("n_items"), bad.alias("bad"))
    return x.withColumn("ok", F.assert_true(F.col("bad") == 0, F.lit("dropped without a reason"))).where("ok is null").select("n_used", "n_dropped", "n_items")


def chart_of(edges: list[tuple[str, str]]) -> str:
    """A flow chart of precedences, for tests and demonstrations."""
    names = {n: f"v{i}" for i, n in enumerate(kernels.smallest_order(edges))}
    return "flowchart TB\n" + "".join(f"{v}([{n}])\n" for n, v in names.items()) + "".join(f"{names[a]} --> {names[b]}\n" for a, b in edges)
