"""Accuracy of keyword, second opinion and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, RoutingConfig
from quillspark.functions.routing import classify, decide
from quillspark.functions.text import blank, confidence
from quillspark.scratch import materialize

BIN_ROWS = 100_000  # of a category that are ranked in one task
BIN_DIGITS = 3  # of a hash, per histogram


def stratified_sample(rows: DataFrame, category: str, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """About ``n`` rows in proportion to their categories, at least one of each, chosen by a hash of seed and key.

    Of every category its share, rounded half to even, of rows with the least hashes is taken; then the first ``n`` by
    hash stay.  A category's last hash is found by histograms: the digit of the hash at which its share ends, then the
    next digits within that bin, until a bin has ``BIN_ROWS`` rows at most.  Only these are ranked, so that no task holds
    a category."""
    if n is None:
        return rows
    sizes = rows.groupBy(F.col(category).alias("_category")).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    share = F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_size") / F.col("_total")).cast("long"))
    wanted = sizes.crossJoin(F.broadcast(total))  # one row
    wanted = wanted.select("_category", "_size", F.when(F.col("_total") <= n, F.col("_size")).otherwise(F.least(share, "_size")).alias("_share"))
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_hash", F.coalesce("_hash", F.lit("")))
    # by category: the hashes below ``_from`` are taken, of those that start with it ``_left`` are still to be
    cut = wanted.select("_category", F.lit("").alias("_from"), F.col("_share").alias("_left"), F.col("_size").alias("_open"))
    cut = materialize(cut, "sample-cuts")
    for digits in range(BIN_DIGITS, 32 + 1, BIN_DIGITS):
        if cut.where(F.col("_open") > BIN_ROWS).isEmpty():
            break
        inside = hashed.join(cut.where(F.col("_open") > BIN_ROWS), F.col(category).eqNullSafe(F.col("_category")) & F.startswith("_hash", "_from"))
        bins = inside.groupBy("_category", "_left", F.left("_hash", F.lit(digits)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        so_far = Window.partitionBy("_category").orderBy("_bin")  # 16 ** BIN_DIGITS bins at most
        bins = bins.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        ends = bins.where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left")))
        ends = ends.select("_category", F.col("_bin").alias("_from"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_n").alias("_open"))
        cut = materialize(cut.where(F.col("_open") <= BIN_ROWS).unionByName(ends), "sample-cuts")
    judged = hashed.join(cut, F.col(category).eqNullSafe(F.col("_category")))
    judged = judged.where((F.col("_hash") < F.col("_from")) | F.startswith("_hash", "_from"))
    below = judged.where(~F.startswith("_hash", "_from"))
    place = F.row_number().over(Window.partitionBy("_category").orderBy("_hash", key))
    last = judged.where(F.startswith("_hash", "_from")).withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    chosen = below.select(*rows.columns, "_hash").unionByName(last.select(*rows.columns, "_hash"))
    return chosen.orderBy("_hash", key).limit(max(n, 0)).drop("_hash")


def evaluate(samples: DataFrame, threshold: float | None = None, config: RoutingConfig = DEFAULT, keyword: Column | None = None) -> DataFrame:
    """The audit row of every sample: needs path, truth_category, text, and the second opinion's llm_category,
    llm_issuer and llm_confidence (null where there is none).

    Samples without text, or with an ``extract_error``, are skipped with a reason and count nowhere else.
    """
    limit = config.second_opinion.confidence_threshold if threshold is None else threshold
    failed = F.col("extract_error").isNotNull() if "extract_error" in samples.columns else F.lit(False)
    skipped = F.when(failed, F.lit("extract_error")).when(blank(F.col("text")), F.lit("no_text"))
    own = keyword if keyword is not None else classify(F.col("text"), config)
    t = samples.withColumn("skipped", skipped).withColumn("keyword_category", F.when(skipped.isNull(), own))
    has = F.col("llm_category").isNotNull() & F.col("skipped").isNull()
    choice = decide(F.col("keyword_category"), F.col("llm_category"), F.col("llm_confidence"), F.col("llm_issuer"), limit)
    t = t.withColumn("_choice", F.when(has, choice))
    t = t.withColumn("hybrid_category", F.when(F.col("skipped").isNull(), F.when(has, F.col("_choice.category")).otherwise(F.col("keyword_category"))))
    t = t.withColumn("hybrid_backend", F.when(F.col("skipped").isNull(), F.when(has, F.col("_choice.backend")).otherwise(F.lit("keyword"))))
    right = lambda c: F.when(F.col("skipped").isNull(), F.coalesce(F.col(c) == F.col("truth_category"), F.lit(False)))
    return t.select(
        *[c for c in samples.columns if c != "text"],
        "keyword_category",
        right("keyword_category").alias("keyword_correct"),
        F.when(has, F.col("llm_category") == F.col("truth_category")).alias("llm_correct"),
        "hybrid_category",
        right("hybrid_category").alias("hybrid_correct"),
        "hybrid_backend",
        F.length(F.coalesce("text", F.lit(""))).alias("text_chars"),
        confidence(F.col("text")).alias("text_confidence"),
        "skipped",
    )


def overall(audit: DataFrame) -> DataFrame:
    """One row of totals and accuracies; the second opinion's accuracy is over the samples it gave a verdict on, and
    its mean time, where ``audit`` has llm_duration_ms, is that of all calls over these samples."""
    done = F.col("skipped").isNull()
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double")), F.lit(0.0))
    given = done & F.col("llm_correct").isNotNull()
    spent = F.sum(F.when(done, F.col("llm_duration_ms"))) if "llm_duration_ms" in audit.columns else F.lit(0)
    return audit.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(done).alias("n_evaluated"),
        F.count_if(~done).alias("n_skipped"),
        F.count_if(given).alias("llm_attempted"),
        F.count_if(F.col("keyword_correct")).alias("keyword_correct"),
        F.count_if(F.col("llm_correct")).alias("llm_correct"),
        F.count_if(F.col("hybrid_correct")).alias("hybrid_correct"),
        share(F.col("keyword_correct"), done).alias("keyword_accuracy"),
        share(F.col("llm_correct"), given).alias("llm_accuracy"),
        share(F.col("hybrid_correct"), done).alias("hybrid_accuracy"),
        F.coalesce(F.try_divide(spent.cast("double"), F.count_if(given).cast("double")), F.lit(0.0)).alias("llm_mean_ms"),
    )


def skip_reasons(audit: DataFrame) -> DataFrame:
    return audit.where("skipped is not null").groupBy("skipped").agg(F.count(F.lit(1)).alias("n"))


def by_category(audit: DataFrame) -> DataFrame:
    done = audit.where("skipped is null")
    right = [F.count_if(F.col(c)).alias(c) for c in ("keyword_correct", "llm_correct", "hybrid_correct")]
    return done.groupBy("truth_category").agg(F.count(F.lit(1)).alias("n"), *right)


def confusion(audit: DataFrame) -> DataFrame:
    """(truth, predicted, n) of the combined verdict."""
    done = audit.where("skipped is null")
    return done.groupBy(F.col("truth_category").alias("truth"), F.coalesce("hybrid_category", F.lit("(none)")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def helped_and_hurt(audit: DataFrame) -> DataFrame:
    """(path, effect): where the second opinion was right and the keyword wrong, and the other way round."""
    effect = F.when(F.col("llm_correct") & ~F.col("keyword_correct"), F.lit("helped")).when(~F.col("llm_correct") & F.col("keyword_correct"), F.lit("hurt"))
    return audit.where("skipped is null").withColumn("effect", effect).where("effect is not null")
