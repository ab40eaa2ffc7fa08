"""Mixing sources to target shares, by nested hash thresholds.

A source is used whole as often as its budget holds its tokens; the rest of
the budget goes to the documents whose hash lies below a threshold. The
threshold is found in histograms: tokens are summed by source and hash bucket,
the bucket in which the running sum passes the budget is cut into finer
buckets, and so on until a bucket can't be cut. No row is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name
from tidemark.llm.tokens import with_token_counts
from tidemark.storage import written

#: Bits of each level of the threshold; 3 levels decide among 2**30 hash values.
LEVEL_BITS = 10
LEVELS = 3


def _bounded_targets(targets: DataFrame, limit: int = 100_000) -> list:
    rows = targets.select(clean_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    rows = rows.where("source is not null and share is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} target sources")
    return rows


def mix_plan(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """The sized rows of the wanted sources, and each source's use.

    ``sizes`` has ``doc_id, source, n_tokens`` with a clean source. The wanted
    mix has as many tokens as all rows of ``sizes`` together. A source's entry
    holds ``budget``, ``available`` (one use), ``whole`` (full uses), and
    ``below``: documents whose 30-bit hash is below it are used once more.
    """
    spark = sizes.sparkSession
    want = {r.source: {"share": float(r.share), "repeats": max(int(r.repeats or 0), 0)} for r in _bounded_targets(targets)}
    bits = LEVEL_BITS * LEVELS
    rows = sizes.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)))
    # the target sources were counted when they were read
    names = spark.createDataFrame([(s, True) for s in want], "source string, named boolean")
    rows = rows.join(F.broadcast(names), "source", "left")
    first = rows.groupBy("source", "named", F.shiftright("h", bits - LEVEL_BITS).alias("b")).agg(F.sum("n_tokens").alias("t"))
    # sources not wanted only count towards the total
    level = first.groupBy(F.when(F.col("named"), F.col("source")).alias("source"), F.when(F.col("named"), F.col("b")).alias("b")).agg(F.sum("t").alias("t")).collect()
    total = sum(r.t or 0 for r in level)
    cells: dict[str, dict[int, int]] = {s: {} for s in want}
    for r in level:
        if r.source is not None:
            cells[r.source][r.b] = int(r.t or 0)
    for s, w in want.items():
        w["budget"] = w["share"] * total
        w["available"] = sum(cells[s].values())
        w["whole"] = int(min(w["repeats"], w["budget"] // w["available"])) if w["available"] else 0
        w["left"] = w["budget"] - w["whole"] * w["available"] if w["whole"] < w["repeats"] else 0.0
        w["below"], w["prefix"], w["open"] = 0, 0, w["left"] > 0 and w["available"] > 0
    wanted = rows.where("named").drop("named")
    for k in range(LEVELS):
        shift = bits - LEVEL_BITS * (k + 1)
        if k:
            live = {s: w["prefix"] for s, w in want.items() if w["open"]}
            if not live:
                break
            on = spark.createDataFrame(list(live.items()), "source string, prefix bigint")
            near = wanted.join(F.broadcast(on), "source").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
            cells = {s: {} for s in live}
            for r in near.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
                cells[r.source][r.b] = int(r.t)
        for s, w in want.items():
            if not w["open"]:
                continue
            for b in sorted(cells[s]):
                if cells[s][b] > w["left"]:
                    w["prefix"] = b
                    if k == LEVELS - 1:
                        # the last bucket is taken if that comes closer to the budget
                        w["open"] = False
                        w["below"] = (b + (cells[s][b] - w["left"] < w["left"])) << shift
                    break
                w["left"] -= cells[s][b]
                w["below"] = (b + 1) << shift
            else:
                w["open"] = False
                w["below"] = 1 << bits
    return wanted, want


def mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the documents used at least once."""
    rows, want = mix_plan(sizes, targets)
    plan = sizes.sparkSession.createDataFrame([(s, w["whole"], w["below"]) for s, w in want.items()], "source string, whole int, below bigint")
    out = rows.join(F.broadcast(plan), "source").withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``, written once; null texts have 0 tokens."""
    rows = documents.select("doc_id", clean_name(F.col("source")).alias("source"), "text")
    return written(with_token_counts(rows, "text", "n_tokens", vocabulary), "sizes")


def mix_documents(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The mix of the documents. Documents of unwanted or no source are not used."""
    return mix(sized_documents(documents, vocabulary), targets)


def mix_report(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per target source: wanted and reached tokens and shares, and whether it falls short.

    ``short`` means that all documents used ``max_repeats`` times have fewer
    tokens than the budget. ``reached_share`` is of the tokens of the mix.
    """
    sizes = sized_documents(documents, vocabulary)
    rows, want = mix_plan(sizes, targets)
    plan = sizes.sparkSession.createDataFrame(
        [(s, w["share"], w["repeats"], w["budget"], w["available"], w["whole"], w["below"]) for s, w in want.items()],
        "source string, target_share double, max_repeats int, budget_tokens double, available_tokens bigint, whole int, below bigint",
    )
    used = rows.join(F.broadcast(plan.select("source", "whole", "below")), "source")
    used = used.withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    used = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"), F.sum((F.col("copies") > 0).cast("bigint")).alias("documents"), F.max("copies").alias("most_copies"))
    out = plan.join(used, "source", "left").na.fill(0, ["reached_tokens", "documents", "most_copies"])
    sums = out.agg(F.sum("reached_tokens").alias("mix_tokens"))
    out = out.crossJoin(F.broadcast(sums))  # one row
    share = F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0))
    short = F.col("available_tokens") * F.col("max_repeats") < F.col("budget_tokens")
    return out.select("source", "target_share", "max_repeats", "budget_tokens", "available_tokens", "reached_tokens", "documents", "most_copies", F.round(share, 6).alias("reached_share"), short.alias("short"))
