"""Quality metrics of scores against labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.operators.ranking import average_ranks


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        _count_if(predicted & actual).alias("tp"),
        _count_if(predicted & ~actual).alias("fp"),
        _count_if(~predicted & ~actual).alias("tn"),
        _count_if(~predicted & actual).alias("fn"),
    )


def with_rates(counts: DataFrame, digits: int = 9) -> DataFrame:
    """precision, recall, f1, accuracy, error_rate from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    precision = F.when(tp + fp > 0, F.try_divide(tp, tp + fp)).otherwise(1.0)
    recall = F.when(tp + fn > 0, F.try_divide(tp, tp + fn)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, F.try_divide(2 * precision * recall, precision + recall)).otherwise(0.0)
    return counts.select(
        "*",
        F.round(precision, digits).alias("precision"),
        F.round(recall, digits).alias("recall"),
        F.round(f1, digits).alias("f1"),
        F.round(F.when(total > 0, F.try_divide(tp + tn, total)).otherwise(1.0), digits).alias("accuracy"),
        F.round(F.when(total > 0, F.try_divide(fp + fn, total)).otherwise(0.0), digits).alias("error_rate"),
    )


def threshold_sweep(
    df: DataFrame, score: str, actual: Column, first: int = 0, last: int = 99
) -> DataFrame:
    """Confusion counts for t = first/100 .. last/100, score >= t being positive.

    One pass: each score is counted at the highest threshold it reaches, then a
    reverse running sum over the hundred thresholds gives every row of the sweep.
    """
    reached = F.lit(first - 1)
    # floor(score * 100) can be off by one through binary rounding; settle it
    # by comparing with the thresholds themselves.
    guess = F.floor(F.col(score) * 100).cast("int")
    settled = (
        F.when(F.col(score) >= (guess + 1) / F.lit(100), guess + 1)
        .when(F.col(score) >= guess / F.lit(100), guess)
        .otherwise(guess - 1)
    )
    reached = F.greatest(F.least(settled, F.lit(last)), reached)
    counted = df.select(reached.alias("step"), actual.cast("bigint").alias("is_pos")).groupBy("step").agg(
        F.sum("is_pos").alias("pos"), F.count("*").alias("n")
    )
    steps = df.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("step"))
    full = steps.join(counted, "step", "left").na.fill(0, ["pos", "n"])
    at_least = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    tp = F.sum("pos").over(at_least)
    predicted = F.sum("n").over(at_least)
    all_pos, all_n = F.sum("pos").over(everything), F.sum("n").over(everything)
    return (
        full.select(
            "step",
            tp.alias("tp"),
            (predicted - tp).alias("fp"),
            (all_n - predicted - (all_pos - tp)).alias("tn"),
            (all_pos - tp).alias("fn"),
        )
        .filter(F.col("step") >= first)
        .select((F.col("step") / 100).alias("threshold"), "tp", "fp", "tn", "fn")
    )


def best_threshold(rates: DataFrame) -> DataFrame:
    """The row of the highest F1; the lowest threshold on ties."""
    best = F.min_by(F.struct(*rates.columns), F.struct(-F.col("f1"), F.col("threshold")))
    return rates.agg(best.alias("best")).select("best.*")


def auc(df: DataFrame, score: str, actual: Column, bucket: Column) -> DataFrame:
    """Mann-Whitney area under the curve with average ranks for ties."""
    ranks = average_ranks(df, score, bucket)
    positives = df.filter(actual).groupBy(score).agg(F.count("*").alias("n_pos"))
    joined = ranks.join(positives, score, "left").na.fill(0, ["n_pos"])
    sums = joined.agg(
        F.sum(F.col("rank") * F.col("n_pos")).alias("rank_sum"),
        F.sum("n_pos").alias("n_pos"),
        F.sum(F.col("n") - F.col("n_pos")).alias("n_neg"),
    )
    # As doubles: the products outgrow a bigint from about 3e9 rows of a class.
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    u = F.col("rank_sum") - pos * (pos + 1) / 2
    return sums.select(
        "n_pos", "n_neg", F.round(F.try_divide(u, pos * neg), 9).alias("auc")
    )


def spearman(df: DataFrame, x: str, y: str, x_bucket: Column, y_bucket: Column) -> DataFrame:
    """Pearson correlation of average ranks, from distinct (x, y) pairs with counts."""
    pairs = df.groupBy(x, y).agg(F.count("*").alias("w"))
    rx = average_ranks(df, x, x_bucket, "rx").select(x, "rx")
    ry = average_ranks(df, y, y_bucket, "ry").select(y, "ry")
    ranked = pairs.join(rx, x).join(ry, y)
    # Centred on their mean, ranks of a constant column are exactly 0.
    mean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.count("*") + 1) / 2).scalar()
    w, a, b = F.col("w"), F.col("rx") - mean, F.col("ry") - mean
    sums = ranked.agg(
        F.sum("w").alias("n"),
        F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"),
    )
    cov, var_x, var_y = F.col("sab"), F.col("saa"), F.col("sbb")
    rho = (
        F.when((var_x == 0) & (var_y == 0), 1.0)
        .when((var_x == 0) | (var_y == 0), 0.0)
        .otherwise(F.try_divide(cov, F.sqrt(var_x) * F.sqrt(var_y)))
    )
    return sums.select("n", F.round(rho, 6).alias("rho"))


def mean_absolute_error(df: DataFrame, expected: str, actual: str) -> DataFrame:
    error = F.abs(F.col(expected) - F.col(actual))
    return df.agg(F.count("*").alias("n"), F.round(F.avg(error), 9).alias("mae"))


def retrieval_accuracy(df: DataFrame, query: str, score: str, item: str, same_label: Column) -> DataFrame:
    """Share of queries whose first, and whose first three, items hold the right label."""
    window = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    top = df.withColumn("_r", F.row_number().over(window)).filter("_r <= 3")
    per_query = top.groupBy(query).agg(
        F.max(((F.col("_r") == 1) & same_label).cast("int")).alias("top1"),
        F.max(same_label.cast("int")).alias("top3"),
    )
    return per_query.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("top1"), 9).alias("top1_accuracy"),
        F.round(F.avg("top3"), 9).alias("top3_accuracy"),
    )


def mean_similarity_matrix(left: DataFrame, right: DataFrame, left_label: str, right_label: str) -> DataFrame:
    """Mean cosine over all (left, right) pairs per pair of labels.

    The mean of dot products is the dot product of the mean unit vectors, so the
    pairs themselves are never formed: vectors are averaged per (label, position)
    and the small averages are joined on position.
    """

    def means(df: DataFrame, label: str, out: str) -> DataFrame:
        return (
            df.filter(F.col("unit").isNotNull())
            .select(F.col(label).alias(out), F.posexplode("unit").alias("i", "x"))
            .groupBy(out, "i")
            .agg(F.avg("x").alias(f"{out}_mean"))
        )

    a, b = means(left, left_label, "jd_label"), means(right, right_label, "cv_label")
    return (
        a.join(b, "i")
        .groupBy("jd_label", "cv_label")
        .agg(F.round(F.sum(F.col("jd_label_mean") * F.col("cv_label_mean")), 6).alias("mean_cosine"))
    )


def score_summary(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Min, mean and max of each class, the margin, and how many rows overlap it."""
    pos, neg = F.when(positive, F.col(score)), F.when(~positive, F.col(score))
    counts = df.groupBy(score).agg(
        F.sum(positive.cast("bigint")).alias("p"), F.sum((~positive).cast("bigint")).alias("q")
    )
    stats = df.agg(
        F.min(pos).alias("pos_min"), F.avg(pos).alias("pos_mean"), F.max(pos).alias("pos_max"),
        F.min(neg).alias("neg_min"), F.avg(neg).alias("neg_mean"), F.max(neg).alias("neg_max"),
    )
    pos_min, neg_max = stats.select("pos_min").scalar(), stats.select("neg_max").scalar()
    overlap = counts.agg(
        F.coalesce(F.sum(F.when(F.col(score) <= neg_max, F.col("p"))), F.lit(0)).alias("confusable_pos"),
        F.coalesce(F.sum(F.when(F.col(score) >= pos_min, F.col("q"))), F.lit(0)).alias("confusable_neg"),
    )
    return overlap.select(
        "confusable_pos",
        "confusable_neg",
        *[stats.select(F.round(c, 6)).scalar().alias(c) for c in stats.columns],
        stats.select(F.round(F.col("pos_min") - F.col("neg_max"), 6)).scalar().alias("margin"),
    )


def coverage(df: DataFrame, category: str, found: Column) -> DataFrame:
    return df.groupBy(category).agg(
        F.count("*").alias("cases"),
        F.sum(found.cast("bigint")).alias("found"),
        F.round(100 * F.sum(found.cast("bigint")) / F.count("*"), 6).alias("percent"),
    )


def compound_risk(misses: DataFrame, keys: list[str], p: str, depth: int = 10) -> DataFrame:
    """Chance that at least one of k requirements is missed, for k = 1 .. depth."""
    return misses.select(
        *keys, p, F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("k")
    ).withColumn("risk", F.round(1 - F.pow(1 - F.col(p), F.col("k")), 9))


def passes(df: DataFrame, expected: str, actual: str, tolerance: float) -> DataFrame:
    ok = F.abs(F.col(expected) - F.col(actual)) < tolerance
    return df.agg(F.count("*").alias("cases"), F.sum(ok.cast("bigint")).alias("passed"))


def decreases(df: DataFrame, keys: list[str], along: str, score: str, tolerance: float) -> DataFrame:
    """Rows whose score falls below the previous one along an axis."""
    window = Window.partitionBy(*keys).orderBy(along)
    return (
        df.withColumn("previous", F.lag(score).over(window))
        .filter(F.col(score) < F.col("previous") - tolerance)
    )


def distance_label(cv_rank: Column, jd_rank: Column) -> Column:
    """How close a degree is to the required one, by level gap."""
    gap = jd_rank - cv_rank
    return (
        F.when(jd_rank == 0, 1.0)
        .when(cv_rank == 0, 0.5)
        .when(gap <= 0, 1.0)
        .when(gap == 1, 0.65)
        .when(gap == 2, 0.3)
        .otherwise(0.1)
    )


_PAIR_STATISTICS = "n_same long, sum_same double, min_same double, max_same double, n_cross long, sum_cross double, min_cross double, max_cross double, above long"


def _block_pairs(units: DataFrame, id_column: str, label: str, blocks: int, limit: float | None, cells: int = 1 << 22) -> DataFrame:
    """Statistics of the cosines of every two blocks of units, by matrix products."""

    def compare(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(other):
            ids, labels, units = (one[c].to_numpy() for c in ("id", "label", "unit"))
            other_ids, other_labels, right = other["id_b"].to_numpy(), other["label_b"].to_numpy(), np.stack(other["unit_b"].to_numpy()).T
            inside = one["x"].iat[0] == one["y"].iat[0]
            rows = max(1, cells // len(other_ids))
            for i in range(0, len(ids), rows):
                cosine = np.round(np.stack(units[i : i + rows]) @ right, 6)
                paired = ids[i : i + rows, None] < other_ids if inside else np.ones(cosine.shape, bool)
                equal = labels[i : i + rows, None] == other_labels
                row = []
                for held in (cosine[paired & equal], cosine[paired & ~equal]):
                    row += [len(held), held.sum(), *((held.min(), held.max()) if len(held) else (None, None))]
                above = 0 if limit is None else int((cosine[paired & equal] > limit).sum())
                out.append((*row, above))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAIR_STATISTICS.split(", ")])

    own = units.select(F.col(id_column).alias("id"), F.col(label).alias("label"), "unit")
    own = own.where(F.col("label").isNotNull() & F.col("unit").isNotNull() & ~F.exists("unit", lambda x: x.isNull()))
    own = own.select("*", F.size("unit").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    left = own.withColumn("x", F.col("block")).withColumn("y", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    other = own.select(*[F.col(c).alias(f"{c}_b") for c in own.columns])  # names of its own, as both sides are one table
    right = other.withColumn("y_b", F.col("block_b")).withColumn("x_b", F.explode(F.sequence(F.lit(0), F.col("block_b"))))
    return left.groupBy("size", "x", "y").cogroup(right.groupBy("size_b", "x_b", "y_b")).applyInPandas(compare, _PAIR_STATISTICS)


def pair_blocks(vectors: int, longest: int, tasks: int, block_rows: int, block_bytes: int = 16 << 20) -> int:
    """Into how many blocks to cut: `block_rows` vectors in each until pairs of blocks fill the
    tasks, then larger ones up to `block_bytes`, as every vector is sent once per block."""
    largest = max(block_rows, block_bytes // (8 * max(longest, 1)))
    return max(vectors // largest + 1, min(vectors // block_rows + 1, math.ceil(math.sqrt(2 * tasks))))


def pair_statistics(units: DataFrame, id_column: str, label: str, block_rows: int = 4096) -> DataFrame:
    """Cosines of all pairs of `unit` vectors with ids a < b: least, mean and largest within
    and across labels, and how many pairs within lie above the largest across.

    Every two blocks of vectors meet in one task, so a task's memory is bounded and the
    work is one product per pair. Vectors travel as often as there are blocks. Vectors of different length are not compared.
    """
    vectors, longest = units.agg(F.count("*"), F.coalesce(F.max(F.size("unit")), F.lit(0))).first()
    blocks = pair_blocks(vectors, longest, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), block_rows)
    limit = _block_pairs(units, id_column, label, blocks, None).agg(F.max("max_cross")).first()[0]
    mean = lambda name: F.round(F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")), 6)
    return _block_pairs(units, id_column, label, blocks, limit).agg(
        F.min("min_same").alias("within_min"), mean("same").alias("within_mean"), F.max("max_same").alias("within_max"),
        F.min("min_cross").alias("cross_min"), mean("cross").alias("cross_mean"), F.max("max_cross").alias("cross_max"),
        F.coalesce(F.sum("above"), F.lit(0)).alias("above"),
    )


def hard_pairs(pairs: DataFrame, named: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Per named pair of labels: number of pairs, mean and largest score, and how many pairs
    reach the weakest score of all positive pairs. `pairs` is read twice."""
    weakest = pairs.agg(F.min(F.when(positive, F.col(score))).alias("_weakest"))
    reached = F.coalesce(F.sum((F.col(score) >= F.col("_weakest")).cast("bigint")), F.lit(0))
    return (
        pairs.join(F.broadcast(named.distinct()), keys, "left_semi")
        .join(F.broadcast(weakest))  # one row
        .groupBy(*keys)
        .agg(F.count("*").alias("pairs"), F.round(F.avg(score), 6).alias("mean_cosine"), F.max(score).alias("max_cosine"), reached.alias("above"))
    )
