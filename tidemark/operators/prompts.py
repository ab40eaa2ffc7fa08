"""Packing recalled fragments into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import word_count

HEADER = "Memory fragments:\n"


def block(rank: Column, own_id: Column, content: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), own_id, F.lit(": "), content, F.lit("\n"))


def assemble(df: DataFrame, query: str, rank: str, item: str, content: str, question: Column, task: Column, limit: int = 2048) -> DataFrame:
    """``query, prompt, prompt_tokens, included, omitted, kept_task``.

    System text, header and question always stand; the task context goes first
    when they don't fit with it. Blocks follow in rank order, one that would
    exceed the budget is left out and the next is tried. Tokens are words.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col(content).alias("c"))))
    per = df.where(F.trim(F.coalesce(F.col(content), F.lit(""))) != "").groupBy(query).agg(rows.alias("rows"), F.first(question).alias("_q"), F.first(task).alias("_t"))
    fixed = word_count(F.col("_q")) + word_count(F.lit(HEADER))
    keep = word_count(F.col("_t")) + fixed <= limit
    base = F.when(keep, word_count(F.col("_t"))).otherwise(0) + fixed
    zero = F.struct(base.cast("int").alias("n"), F.lit("").alias("text"), F.array().cast("array<string>").alias("inc"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        b = block(x["r"], x["i"], x["c"])
        n = s["n"] + word_count(b)
        fits = F.struct(n.alias("n"), F.concat(s["text"], b).alias("text"), F.concat(s["inc"], F.array(x["i"])).alias("inc"), s["out"].alias("out"))
        skip = F.struct(s["n"].alias("n"), s["text"].alias("text"), s["inc"].alias("inc"), F.concat(s["out"], F.array(x["i"])).alias("out"))
        return F.when(n <= limit, fits).otherwise(skip)

    out = per.where(fixed <= limit).withColumn("_k", keep).withColumn("_s", F.aggregate("rows", zero, step))
    memory = F.when(F.size("_s.inc") > 0, F.col("_s.text")).otherwise("(none)\n")
    prompt = F.concat(F.when(F.col("_k"), F.concat("_t", F.lit("\n"))).otherwise(""), F.lit(HEADER), memory, F.lit("\n"), F.col("_q"))
    return out.select(query, prompt.alias("prompt"), word_count(prompt).cast("bigint").alias("prompt_tokens"), F.col("_s.inc").alias("included"), F.col("_s.out").alias("omitted"), F.col("_k").alias("kept_task"))
