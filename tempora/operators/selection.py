"""Context selection under a budget: greedy packing, 0/1 knapsack, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS, CHARS_PER_TOKEN, SLOTS = 4000, 4, 4


def greedy_picks(items: Column, budget: int) -> Column:
    """Ids of the items taken in order while they fit; one that does not fit is passed over. items: structs (.., id, cost)."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["cost"]
        taken = F.struct(F.concat(s["ids"], F.array(x["id"])).alias("ids"), used.alias("used"))
        return F.when(used <= budget, taken).otherwise(s)

    return F.aggregate(items, start, step, lambda s: s["ids"])


def greedy_pack(candidates: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """Candidates that fit the budget by falling score, with score_rank and time_rank (from 0).

    candidates: query_id, chunk_id, text, score, is_cross_scene_subchunk, start_sec. Half a sentence costs twice its
    length, since its other half comes along; a missing start counts as 0. Lists are as long as a query's candidates.
    """
    cost = F.char_length(F.coalesce("text", F.lit(""))) * F.when(F.col("is_cross_scene_subchunk"), 2).otherwise(1)
    item = F.struct((-F.col("score")).alias("order"), F.col("chunk_id").alias("id"), cost.cast("long").alias("cost"))
    picks = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    picks = picks.select("query_id", F.posexplode(greedy_picks(F.col("items"), tokens * CHARS_PER_TOKEN)).alias("score_rank", "chunk_id"))
    time = Window.partitionBy("query_id").orderBy(F.coalesce("start_sec", F.lit(0.0)), "score_rank")
    return candidates.join(picks, ["query_id", "chunk_id"]).withColumn("time_rank", F.row_number().over(time) - 1)


def knapsack_items(candidates: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, ord, weight, value, text, keyframe_paths.

    candidates: query_id, ord, chunk_id, parent_chunk_id, is_cross_scene_subchunk, text, keyframe_path, rerank_score,
    s_total. Halves of one sentence are one item of weight 2, that of the first; partners (parent_chunk_id, text,
    keyframe_path) add the other half's text and image.
    """
    pair = F.coalesce(F.col("parent_chunk_id") != "", F.lit(False)) & F.coalesce("is_cross_scene_subchunk", F.lit(False))
    own = candidates.withColumn("pair", pair).withColumn("item_id", F.when(pair, F.col("parent_chunk_id")).otherwise(F.col("chunk_id")))
    first = F.row_number().over(Window.partitionBy("query_id", "pair", F.when(pair, F.col("item_id")).otherwise(F.concat_ws("|", "chunk_id", "ord"))).orderBy("ord"))
    own = own.withColumn("_n", first).filter("_n = 1").drop("_n")
    if partners is None:
        own = own.withColumns({"_text": F.lit(None).cast("string"), "_path": F.lit(None).cast("string")})
    else:
        other = partners.select(F.col("parent_chunk_id").alias("_parent"), F.col("text").alias("_text"), F.col("keyframe_path").alias("_path"))
        own = own.join(other, own.pair & (own.parent_chunk_id == other["_parent"]), "left")
    paths = F.filter(F.array("keyframe_path", "_path"), lambda p: p.isNotNull() & (p != ""))
    value = F.coalesce("rerank_score", "s_total", F.lit(0.0))
    return own.select("query_id", "item_id", "ord", F.when(F.col("pair"), 2).otherwise(1).alias("weight"), value.alias("value"), F.trim(F.concat_ws(" ", "text", "_text")).alias("text"), paths.alias("keyframe_paths"))


def best_picks(items: Column, capacity: int) -> Column:
    """The best value and ids for a capacity. items: array of structs (ord, id, weight, value) in order.

    The fold keeps the best (value, ids) of each capacity and replaces it only by a strictly greater value, so earlier items
    win ties and items without value are never taken.
    """
    cell = F.struct(F.lit(0.0).alias("value"), F.array().cast("array<string>").alias("ids"))
    start = F.array_repeat(cell, max(0, capacity) + 1)

    def step(s: Column, x: Column) -> Column:
        def at(old: Column, w: Column) -> Column:
            rest = F.get(s, (w - x["weight"]).cast("int"))
            value = rest["value"] + x["value"]
            return F.when((w >= x["weight"]) & (value > old["value"]), F.struct(value.alias("value"), F.concat(rest["ids"], F.array(x["id"])).alias("ids"))).otherwise(old)

        return F.transform(s, at)

    return F.aggregate(items, start, step, lambda s: F.element_at(s, -1))


def knapsack(items: DataFrame, capacity: int = SLOTS) -> DataFrame:
    """query_id, total_value, item_ids. items: query_id, item_id, ord, weight, value; lists are a query's candidates."""
    item = F.struct("ord", F.col("item_id").cast("string").alias("id"), "weight", F.col("value").cast("double").alias("value"))
    best = items.groupBy("query_id").agg(best_picks(F.array_sort(F.collect_list(item)), capacity).alias("best"))
    return best.select("query_id", F.col("best.value").alias("total_value"), F.col("best.ids").alias("item_ids"))


def trake(selected: DataFrame) -> DataFrame:
    """Provenance of selected items: chunk_id, timestamp (the middle of the chunk), keyframe_path, weight_used, knapsack_value."""
    return selected.select("query_id", F.col("item_id").alias("chunk_id"), ((F.col("start_sec") + F.col("end_sec")) / 2).alias("timestamp"), "keyframe_path", F.col("weight").alias("weight_used"), F.round("value", 5).alias("knapsack_value"))


def context(rows: DataFrame, order: str, separator: str = "\n") -> DataFrame:
    """query_id, context: the non-empty texts of a query in order."""
    told = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.filter("text <> ''").groupBy("query_id").agg(F.array_join(F.transform(told, lambda x: x["text"]), separator).alias("context"))
