"""Quality metrics, experiments as grids over the tables, and property checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.constants import CHECK_TOLERANCE, FUZZY_THRESHOLD
from talentloom.functions import cleaning, text
from talentloom.functions.skills import proficiency
from talentloom.functions.strings import strip
from talentloom.operators import fuzzy, metrics, scoring
from talentloom.operators.blocks import pair_cosines
from talentloom.operators.resolve import resolve_names
from talentloom.plans import oracle as o
from talentloom.plans import properties
from talentloom.plans.queries_cleaning import WORDS
from talentloom.plans.queries_matching import ranks
from talentloom.plans.registry import query
from talentloom.plans.screening import Screening
from talentloom.session import materialise
from talentloom.sources.tables import Tables


def cosine_bucket(column: str = "cosine") -> Column:
    return F.floor(F.col(column) * 2048)


_RATES = """
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END::DOUBLE AS r,
  CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 1.0 END::DOUBLE AS acc,
  CASE WHEN tp + fp + tn + fn > 0 THEN (fp + fn) / (tp + fp + tn + fn) ELSE 0.0 END::DOUBLE AS err"""


def _rated(counts: str, keys: str = "") -> str:
    return f"""
      SELECT {keys} tp, fp, tn, fn, round(p, 9) AS precision, round(r, 9) AS recall,
        round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9)::DOUBLE AS f1, round(acc, 9) AS accuracy, round(err, 9) AS error_rate
      FROM (SELECT *, {_RATES} FROM ({counts}))"""


def _counts(predicted: str, actual: str) -> str:
    return (
        f"count(*) FILTER ({predicted} AND {actual}) AS tp, count(*) FILTER ({predicted} AND NOT {actual}) AS fp, "
        f"count(*) FILTER (NOT {predicted} AND NOT {actual}) AS tn, count(*) FILTER (NOT {predicted} AND {actual}) AS fn"
    )


def _sweep(source: str, score: str, first: int, last: int) -> str:
    """Every threshold against every row, the plain way."""
    return f"""
      SELECT t / 100 AS threshold, {_counts(f'{score} >= t / 100', 'same')}
      FROM {source} JOIN (SELECT unnest(range({first}, {last + 1})) AS t) ON true GROUP BY t"""


@query(
    "A4_A6_confusion_and_rates",
    o.sql(_rated(f"SELECT jd_label, {_counts('cosine >= 0.1::DOUBLE', 'same')} FROM labelled_pairs GROUP BY jd_label", "jd_label,")),
)
def _(t: Tables) -> DataFrame:
    counts = metrics.confusion(t.labelled_pairs, F.col("cosine") >= 0.1, F.col("same"), ["jd_label"])
    return metrics.with_rates(counts)


@query("A5_threshold_sweep", o.sql(_rated(_sweep("labelled_pairs", "cosine", 0, 99), "threshold,")))
def _(t: Tables) -> DataFrame:
    return metrics.with_rates(metrics.threshold_sweep(t.labelled_pairs, "cosine", F.col("same")))


@query(
    "A7_best_threshold",
    o.sql(f"SELECT * FROM ({_rated(_sweep('labelled_pairs', 'cosine', 0, 99), 'threshold,')}) ORDER BY f1 DESC, threshold LIMIT 1"),
)
def _(t: Tables) -> DataFrame:
    sweep = metrics.threshold_sweep(t.labelled_pairs, "cosine", F.col("same"))
    return metrics.best_threshold(metrics.with_rates(sweep))


@query(
    "A8_auc",
    o.sql("""
      SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 9) AS auc FROM (
        SELECT sum(r) FILTER (same) AS s, count(*) FILTER (same) AS n_pos, count(*) FILTER (NOT same) AS n_neg FROM (
          SELECT same, rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2 AS r FROM labelled_pairs))"""),
)
def _(t: Tables) -> DataFrame:
    return metrics.auc(t.labelled_pairs, "cosine", F.col("same"), cosine_bucket())


def degree_study(t: Tables) -> DataFrame:
    """Education score against the distance label, for every application."""
    score = scoring.education_score("cv_rank", "jd_rank")
    label = metrics.distance_label(F.col("cv_rank"), F.col("jd_rank"))
    return ranks(t).select(
        "cv_id", "jd_id", "cv_rank", "jd_rank", F.round(score, 9).alias("d4"), label.alias("label")
    )


_DEGREE_STUDY = """(
  SELECT a.cv_id, a.jd_id, c.degree_rank AS cv_rank, j.degree_rank AS jd_rank, round(e.education, 9) AS d4,
    CASE WHEN j.degree_rank = 0 THEN 1.0 WHEN c.degree_rank = 0 THEN 0.5 WHEN j.degree_rank <= c.degree_rank THEN 1.0
      WHEN j.degree_rank - c.degree_rank = 1 THEN 0.65 WHEN j.degree_rank - c.degree_rank = 2 THEN 0.3 ELSE 0.1 END::DOUBLE AS label
  FROM applications a JOIN candidates c ON c.cv_id = a.cv_id JOIN jobs j ON j.jd_id = a.jd_id
  JOIN education e ON e.cv_id = a.cv_id AND e.jd_id = a.jd_id)"""


@query(
    "A9_spearman",
    o.sql(f"""
      SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
        SELECT rank() OVER (ORDER BY d4) + (count(*) OVER (PARTITION BY d4) - 1) / 2 AS rx,
          rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS ry FROM {_DEGREE_STUDY})"""),
)
def _(t: Tables) -> DataFrame:
    return metrics.spearman(
        degree_study(t), "d4", "label", F.floor(F.col("d4") * 1024), F.floor(F.col("label") * 1024)
    )


@query(
    "A10_mean_absolute_error",
    o.sql(f"SELECT count(*) AS n, round(avg(abs(label - d4)), 9) AS mae FROM {_DEGREE_STUDY}"),
)
def _(t: Tables) -> DataFrame:
    return metrics.mean_absolute_error(degree_study(t), "label", "d4")


@query(
    "A11_retrieval_accuracy",
    o.sql("""
      SELECT count(*) AS queries, round(avg(top1), 9) AS top1_accuracy, round(avg(top3), 9) AS top3_accuracy FROM (
        SELECT jd_id, max((r = 1 AND same)::INT) AS top1, max(same::INT) AS top3 FROM (
          SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY cosine DESC, cv_id) AS r FROM labelled_pairs) WHERE r <= 3
        GROUP BY jd_id)"""),
)
def _(t: Tables) -> DataFrame:
    return metrics.retrieval_accuracy(t.labelled_pairs, "jd_id", "cosine", "cv_id", F.col("same"))


def labelled_units(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Unit vectors with labels of all hiring jobs and of all candidates that have one."""
    units = t.units.join(t.vector_labels, "vec_id")
    jd = units.join(t.read("supplier", "s_suppkey").toDF("vec_id"), "vec_id", "left_semi")
    cv = units.join(t.read("customer", "c_custkey").toDF("vec_id"), "vec_id", "left_semi")
    return jd, cv


_MATRIX = """(
  SELECT j.label AS jd_label, c.label AS cv_label,
    round(avg(list_dot_product(j.v, c.v) / (sqrt(list_dot_product(j.v, j.v)) * sqrt(list_dot_product(c.v, c.v)))), 6) AS mean_cosine
  FROM (SELECT * FROM vectors WHERE vec_id IN (SELECT s_suppkey FROM supplier)) j
  JOIN (SELECT * FROM vectors WHERE vec_id IN (SELECT c_custkey FROM customer)) c ON true
  GROUP BY 1, 2)"""


def matrix(t: Tables) -> DataFrame:
    jd, cv = labelled_units(t)
    return metrics.mean_similarity_matrix(jd, cv, "label", "label")


@query("A12_similarity_matrix", o.sql(f"SELECT * FROM {_MATRIX}"))
def _(t: Tables) -> DataFrame:
    """Means over all job x candidate pairs, without forming the pairs."""
    return matrix(t)


@query(
    "A13_margin_and_overlap",
    o.sql("""
      WITH s AS (SELECT min(cosine) FILTER (same) AS pos_min, avg(cosine) FILTER (same) AS pos_mean, max(cosine) FILTER (same) AS pos_max,
        min(cosine) FILTER (NOT same) AS neg_min, avg(cosine) FILTER (NOT same) AS neg_mean, max(cosine) FILTER (NOT same) AS neg_max FROM labelled_pairs)
      SELECT count(*) FILTER (same AND cosine <= neg_max) AS confusable_pos, count(*) FILTER (NOT same AND cosine >= pos_min) AS confusable_neg,
        round(any_value(pos_min), 6) AS pos_min, round(any_value(pos_mean), 6) AS pos_mean, round(any_value(pos_max), 6) AS pos_max,
        round(any_value(neg_min), 6) AS neg_min, round(any_value(neg_mean), 6) AS neg_mean, round(any_value(neg_max), 6) AS neg_max,
        round(any_value(pos_min) - any_value(neg_max), 6) AS margin
      FROM labelled_pairs JOIN s ON true"""),
)
def _(t: Tables) -> DataFrame:
    return metrics.score_summary(t.labelled_pairs, "cosine", F.col("same"))


def twins(t: Tables) -> DataFrame:
    """Neighbouring vectors 2k and 2k + 1 as variants of one text; a.id < b.id."""
    ids = t.vector_labels
    a = ids.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a_id"), (F.col("vec_id") + 1).alias("b_id"), F.col("label").alias("a_label"))
    b = ids.select(F.col("vec_id").alias("b_id"), F.col("label").alias("b_label"))
    pairs = materialise(a.join(b, "b_id").select("a_id", "b_id", (F.col("a_label") == F.col("b_label")).alias("same")))
    one, other = (t.vectors.withColumnRenamed("vec_id", c) for c in ("a_id", "b_id"))
    return pairs.join(pair_cosines(pairs, one, other, "a_id", "b_id"), ["a_id", "b_id"]).select(
        "a_id", "b_id", "same", F.round("cosine", 6).alias("cosine")
    )


_TWINS = """(
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label = b.label AS same,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
  FROM vectors a JOIN vectors b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id < b.vec_id)"""


@query("J12_ordered_pairs", o.sql(f"SELECT * FROM {_TWINS}"))
def _(t: Tables) -> DataFrame:
    return twins(t)


@query(
    "A14_paraphrase_robustness",
    o.sql(f"""
      SELECT round(min(cosine) FILTER (same), 6) AS within_min, round(avg(cosine) FILTER (same), 6) AS within_mean,
        round(avg(cosine) FILTER (NOT same), 6) AS cross_mean, round(max(cosine) FILTER (NOT same), 6) AS cross_max,
        count(*) FILTER (same AND cosine > (SELECT max(cosine) FROM {_TWINS} WHERE NOT same)) AS above
      FROM {_TWINS}"""),
)
def _(t: Tables) -> DataFrame:
    pairs = twins(t)
    cross_max = pairs.filter(~F.col("same")).select(F.max("cosine")).scalar()
    within, cross = F.when(F.col("same"), F.col("cosine")), F.when(~F.col("same"), F.col("cosine"))
    return pairs.agg(
        F.round(F.min(within), 6).alias("within_min"),
        F.round(F.avg(within), 6).alias("within_mean"),
        F.round(F.avg(cross), 6).alias("cross_mean"),
        F.round(F.max(cross), 6).alias("cross_max"),
        F.coalesce(F.sum((within > cross_max).cast("bigint")), F.lit(0)).alias("above"),
    )


_ALL_PAIRS = """(
  SELECT a.label = b.label AS same,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
  FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id)"""


@query(
    "A14_all_pairs",
    o.sql(f"""
      SELECT round(min(cosine) FILTER (same), 6) AS within_min, round(avg(cosine) FILTER (same), 6) AS within_mean,
        round(max(cosine) FILTER (same), 6) AS within_max, round(min(cosine) FILTER (NOT same), 6) AS cross_min,
        round(avg(cosine) FILTER (NOT same), 6) AS cross_mean, round(max(cosine) FILTER (NOT same), 6) AS cross_max,
        count(*) FILTER (same AND cosine > (SELECT max(cosine) FROM {_ALL_PAIRS} WHERE NOT same)) AS above
      FROM {_ALL_PAIRS}"""),
)
def _(t: Tables) -> DataFrame:
    """Robustness over all pairs of one side, not over neighbouring variants only."""
    return metrics.pair_statistics(t.units.join(t.vector_labels, "vec_id"), "vec_id", "label")


@query(
    "J13_A15_hard_pairs",
    o.sql("""
      SELECT jd_label, cv_label, count(*) AS pairs, round(avg(cosine), 6) AS mean_cosine, max(cosine) AS max_cosine,
        count(*) FILTER (cosine >= (SELECT min(cosine) FROM labelled_pairs WHERE same)) AS above
      FROM labelled_pairs WHERE (cv_label = jd_label + 1) OR (jd_label = cv_label + 1) GROUP BY 1, 2"""),
)
def _(t: Tables) -> DataFrame:
    """Applications between neighbouring labels, in both directions: how close they come, and
    how many come as close as the weakest application whose labels agree."""
    label = t.vector_labels.select("label").distinct()
    forward = label.select(F.col("label").alias("jd_label"), (F.col("label") + 1).alias("cv_label"))
    named = forward.union(forward.select(F.col("cv_label"), F.col("jd_label")))
    return metrics.hard_pairs(t.labelled_pairs, named, ["jd_label", "cv_label"], "cosine", F.col("same"))


def spelling_cases(t: Tables) -> DataFrame:
    """Labelled spelling pairs with their similarity: a name and its canonical are the
    same skill, a skill and one it implies are not."""
    names = t.requirements.select(F.lower(strip("name")).alias("name")).distinct().filter(proficiency("name").isNull())
    same = resolve_names(names, t.aliases).filter("name <> canonical").select(
        F.col("name").alias("a"), F.col("canonical").alias("b"), F.lit(True).alias("same")
    )
    other = t.implies.select("src", "dst", F.lit(False))
    return same.union(other).withColumn("ratio", F.round(fuzzy.similarity("a", "b"), 9))


_SPELLING = "(SELECT a, b, same, round(ratio, 9) AS ratio FROM case_ratio)"


@query("A5_fuzzy_threshold_sweep", o.sql(_rated(_sweep(_SPELLING, "ratio", 50, 99), "threshold,")))
def _(t: Tables) -> DataFrame:
    sweep = metrics.threshold_sweep(spelling_cases(t), "ratio", F.col("same"), 50, 99)
    return metrics.with_rates(sweep)


@query(
    "A18_wrong_pairs",
    o.sql(f"SELECT a, b, same, ratio FROM {_SPELLING} WHERE (ratio >= 0.85) <> same"),
)
def _(t: Tables) -> DataFrame:
    """False positives and false negatives at the fixed threshold."""
    return spelling_cases(t).filter((F.col("ratio") >= FUZZY_THRESHOLD) != F.col("same"))


def depth_study(t: Tables) -> DataFrame:
    """Depth and plain years of applications whose job requires years and skills."""
    return t.screening.sliced(_depth_study, ("classes", "hot"))


def _depth_study(s: Screening) -> DataFrame:
    years = s.jobs.filter("min_years > 0").select("jd_id", "min_years", "work_mode")
    weights = s.groups.filter("tier = 'required'").groupBy("jd_id").agg(F.sum("weight").alias("required_weight"))
    jobs = years.join(weights, "jd_id")
    from talentloom.session import salted_join

    pairs = salted_join(s.applications, jobs, ["jd_id"], ["cv_id"])
    return (
        pairs.join(s.sums.select("cv_id", "jd_id", "months"), ["cv_id", "jd_id"], "left")
        .join(s.total_months, "cv_id", "left")
        .select(
            "cv_id", "jd_id", "work_mode",
            F.round(F.coalesce("months", F.lit(0)) / (F.col("min_years") * 12 * F.col("required_weight")), 9).alias("depth_ratio"),
            F.round(scoring.years_share("total_months", "min_years"), 9).alias("years_ratio"),
        )
    )


_DEPTH_STUDY = """(
  SELECT x.cv_id, x.jd_id, j.work_mode, round(x.depth_ratio::DOUBLE, 9) AS depth_ratio, round(x.years_ratio::DOUBLE, 9) AS years_ratio
  FROM experience x JOIN jobs j ON j.jd_id = x.jd_id WHERE x.depth_ratio IS NOT NULL)"""


@query(
    "A19_match_rate_by_category",
    o.sql(f"""
      SELECT work_mode, count(*) AS cases, count(*) FILTER (depth_ratio >= years_ratio) AS matched,
        round(100 * count(*) FILTER (depth_ratio >= years_ratio) / count(*), 6) AS percent,
        coalesce(round(avg(years_ratio - depth_ratio) FILTER (depth_ratio < years_ratio), 6), 0) AS mean_error_when_missed
      FROM {_DEPTH_STUDY} GROUP BY work_mode"""),
)
def _(t: Tables) -> DataFrame:
    hit = F.col("depth_ratio") >= F.col("years_ratio")
    miss = F.when(~hit, F.abs(F.col("years_ratio") - F.col("depth_ratio")))
    return depth_study(t).groupBy("work_mode").agg(
        F.count("*").alias("cases"),
        F.sum(hit.cast("bigint")).alias("matched"),
        F.round(100 * F.sum(hit.cast("bigint")) / F.count("*"), 6).alias("percent"),
        F.coalesce(F.round(F.avg(miss), 6), F.lit(0.0)).alias("mean_error_when_missed"),
    )


@query(
    "A30_depth_against_years",
    o.sql(f"""
      SELECT count(*) AS n, round(corr(rd, ry), 6) AS rho, (SELECT round(avg(abs(depth_ratio - years_ratio)), 6) FROM {_DEPTH_STUDY}) AS mae FROM (
        SELECT rank() OVER (ORDER BY depth_ratio) + (count(*) OVER (PARTITION BY depth_ratio) - 1) / 2 AS rd,
          rank() OVER (ORDER BY years_ratio) + (count(*) OVER (PARTITION BY years_ratio) - 1) / 2 AS ry FROM {_DEPTH_STUDY})"""),
)
def _(t: Tables) -> DataFrame:
    study = depth_study(t)
    rho = metrics.spearman(
        study, "depth_ratio", "years_ratio", F.floor(F.col("depth_ratio") * 1024), F.floor(F.col("years_ratio") * 1024)
    )
    mae = study.select(F.round(F.avg(F.abs(F.col("depth_ratio") - F.col("years_ratio"))), 6)).scalar()
    return rho.withColumn("mae", mae)


@query(
    "A21_binary_agreement",
    o.sql(f"""
      SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy
      FROM (SELECT {_counts('d4 >= 0.7', 'label >= 0.7')} FROM {_DEGREE_STUDY})"""),
)
def _(t: Tables) -> DataFrame:
    counts = metrics.confusion(degree_study(t), F.col("d4") >= 0.7, F.col("label") >= 0.7)
    return metrics.with_rates(counts).select("tp", "fp", "tn", "fn", "accuracy")


@query(
    "A22_worst_errors",
    o.sql(f"""
      SELECT cv_id, jd_id, d4, label FROM {_DEGREE_STUDY} ORDER BY round(abs(d4 - label), 9) DESC, cv_id, jd_id LIMIT 5"""),
)
def _(t: Tables) -> DataFrame:
    error = F.round(F.abs(F.col("d4") - F.col("label")), 9)
    return degree_study(t).orderBy(error.desc(), "cv_id", "jd_id").limit(5).select("cv_id", "jd_id", "d4", "label")


@query("A23_distance_label", o.sql(f"SELECT cv_id, jd_id, label FROM {_DEGREE_STUDY}"))
def _(t: Tables) -> DataFrame:
    return degree_study(t).select("cv_id", "jd_id", "label")


@query(
    "A24_expected_against_actual",
    o.sql(f"SELECT jd_rank::BIGINT AS jd_rank, count(*) AS cases, count(*) AS passed FROM {_DEGREE_STUDY} GROUP BY jd_rank"),
)
def _(t: Tables) -> DataFrame:
    """The education score against the formula written out level by level."""
    expected = F.when(F.col("jd_rank") == 0, 1.0).when(F.col("cv_rank") == 0, 0.5).when(
        F.col("cv_rank") >= F.col("jd_rank"), 1.0
    ).otherwise(F.col("cv_rank") / F.col("jd_rank"))
    ok = F.abs(F.round(expected, 9) - F.col("d4")) < CHECK_TOLERANCE
    return degree_study(t).groupBy(F.col("jd_rank").cast("bigint").alias("jd_rank")).agg(
        F.count("*").alias("cases"), F.sum(ok.cast("bigint")).alias("passed")
    )


def years_grid(t: Tables) -> DataFrame:
    """Each hiring job x 0, 6 .. 144 months of experience, scored by years alone."""
    months = F.explode(F.sequence(F.lit(0), F.lit(144), F.lit(6))).alias("months")
    grid = t.jobs.select("jd_id", "min_years", months)
    score = scoring.experience_score(
        "min_years", F.lit(None).cast("double"), scoring.years_share("months", "min_years")
    )
    return grid.withColumn("score", F.round(score, 9))


_GRID = """(
  SELECT jd_id, min_years, months, round(CASE WHEN min_years = 0 THEN 1.0 ELSE least(months / 12.0::DOUBLE / min_years, 1.0) END::DOUBLE, 9) AS score
  FROM (SELECT jd_id, min_years, unnest(range(0, 145, 6)) AS months FROM jobs))"""


@query("A25_factorial_grid", o.sql(f"SELECT jd_id, months::BIGINT AS months, score FROM {_GRID}"))
def _(t: Tables) -> DataFrame:
    return years_grid(t).select("jd_id", F.col("months").cast("bigint").alias("months"), "score")


def degree_subsets(t: Tables) -> DataFrame:
    """Each hiring job x the 31 non-empty sets of the five levels."""
    levels = F.filter(
        F.sequence(F.lit(1), F.lit(5)),
        lambda i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i - 1).cast("int")) > 0,
    )
    masks = t.jobs.select("jd_id", "degree_rank", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("mask"))
    held = masks.withColumn("levels", levels).withColumn("top", F.array_max("levels"))
    return held.withColumn("score", F.round(scoring.education_score("top", "degree_rank"), 9))


@query(
    "A26_degree_subsets",
    o.sql("""
      SELECT jd_id, mask::BIGINT AS mask, top::BIGINT AS top,
        round(CASE WHEN degree_rank = 0 THEN 1.0 ELSE least(top / degree_rank, 1.0) END::DOUBLE, 9) AS score FROM (
        SELECT jd_id, degree_rank, mask, CASE WHEN mask >= 16 THEN 5 WHEN mask >= 8 THEN 4 WHEN mask >= 4 THEN 3 WHEN mask >= 2 THEN 2 ELSE 1 END AS top
        FROM (SELECT jd_id, degree_rank, unnest(range(1, 32)) AS mask FROM jobs))"""),
)
def _(t: Tables) -> DataFrame:
    return degree_subsets(t).select(
        "jd_id", F.col("mask").cast("bigint").alias("mask"), F.col("top").cast("bigint").alias("top"), "score"
    )


@query(
    "A28_corpus_statistics",
    f"""
      SELECT lang, source, count(*) AS texts, sum(length(text))::BIGINT AS chars, sum({WORDS})::BIGINT AS words,
        sum(greatest(len(regexp_extract_all(text, '[.!?]')), 1))::BIGINT AS sentences FROM documents GROUP BY lang, source""",
)
def _(t: Tables) -> DataFrame:
    stats = text.text_stats("text")
    return t.read("documents", "lang", "source", "text").groupBy("lang", "source").agg(
        F.count("*").alias("texts"),
        F.sum(stats["chars"]).cast("bigint").alias("chars"),
        F.sum(stats["words"]).cast("bigint").alias("words"),
        F.sum(stats["sentences"]).cast("bigint").alias("sentences"),
    )


@query(
    "A29_property_violations",
    o.sql(f"""
      SELECT 'above one' AS kind, count(*) FILTER (score > 1) AS n FROM {_GRID}
      UNION ALL SELECT 'not monotone', count(*) FILTER (score < before) FROM (
        SELECT score, lag(score) OVER (PARTITION BY jd_id ORDER BY months) AS before FROM {_GRID})
      UNION ALL SELECT 'requirement order matters', 0 UNION ALL SELECT 'overlap counts twice', 0
      UNION ALL SELECT 'listing counts as months', 0 UNION ALL SELECT 'education order matters', 0
      UNION ALL SELECT 'other is not high school', 0"""),
)
def _(t: Tables) -> DataFrame:
    """Counts of broken properties, over the grids and over all applications scored again on
    changed inputs; every count should be zero."""
    grid = years_grid(t)
    above = grid.agg(F.lit("above one").alias("kind"), F.coalesce(F.sum((F.col("score") > 1 + CHECK_TOLERANCE).cast("bigint")), F.lit(0)).alias("n"))
    falling = metrics.decreases(grid, ["jd_id"], "months", "score", CHECK_TOLERANCE).agg(
        F.lit("not monotone").alias("kind"), F.count("*").alias("n")
    )
    other = scoring.education_score(cleaning.degree_rank(F.lit("other")), F.col("degree_rank"))
    school = scoring.education_score(cleaning.degree_rank(F.lit("high_school")), F.col("degree_rank"))
    same = t.jobs.filter(other != school).agg(
        F.lit("other is not high school").alias("kind"), F.count("*").alias("n")
    )
    held = F.array(*[F.struct(cleaning.degree(c).alias("degree")) for c in ("degree_text", "second_degree_text")])
    again = properties.broken(t.screening, t.raw_candidates.select("cv_id", held.alias("education")))
    return above.union(falling).union(again).union(same)
