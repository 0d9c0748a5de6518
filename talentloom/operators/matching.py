"""The layered skill match as joins on typed keys.

A token gives keys and a required name asks for keys; a candidate meets a name
with the best key both sides share.

    key kind   a token gives                             layer
    t:token    itself                                    0 exact, 3 fuzzy
    c:skill    its canonical skill, and implied ones     1 identity, 2 entailment
    p:frame    its level in a proficiency framework      4 proficiency

Keys are joined once, on the vocabulary of distinct tokens and names, into a written
index. Candidates then need one join, by token, in which only tokens that very many
candidates list are split. What a candidate meets is worked out once per (candidate,
name); applications are expanded to required names afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.skills import credential_tokens, proficiency
from talentloom.functions.strings import strip
from talentloom.operators.fuzzy import fuzzy_pairs
from talentloom.operators.intervals import merged_spans, union_months
from talentloom.operators.resolve import resolve_names
from talentloom.session import hot_join, salted_join

LAYERS = ("layer0", "layer1", "layer2", "layer3", "proficiency", "missing")
MISSING = len(LAYERS) - 1


def candidate_tokens(
    skills: DataFrame, stacks: DataFrame, credentials: DataFrame, owner: str = "cv_id"
) -> DataFrame:
    """Distinct (owner, token): listed skills, stacks, and split credentials."""
    stacked = stacks.select(owner, F.lower("skill").alias("token"))
    return listed_tokens(skills, credentials, owner).union(stacked).filter("token is not null").distinct()


def listed_tokens(skills: DataFrame, credentials: DataFrame, owner: str = "cv_id") -> DataFrame:
    """Tokens of listed skills and split credentials, repeats included."""
    split = credentials.select(owner, F.explode(credential_tokens("text")).alias("token"))
    return skills.select(owner, F.lower("skill").alias("token")).union(split)


def token_facts(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per distinct token: canonical, found, proficiency level."""
    return resolve_names(tokens, aliases, "token").select(
        "token", "canonical", "found", proficiency("token").alias("level")
    )


def context(tokens: DataFrame, facts: DataFrame, implies: DataFrame, owner: list[str]) -> DataFrame:
    """Per owner: canonical skills (layer 1) and implied skills (layer 2) with a source token."""
    known = tokens.join(facts.select("token", "canonical"), "token")
    direct = known.select(*owner, F.col("canonical").alias("skill"), F.lit(1).alias("layer"), "token")
    implied = known.join(implies.withColumnRenamed("src", "canonical"), "canonical").select(
        *owner, F.col("dst").alias("skill"), F.lit(2).alias("layer"), "token"
    )
    return direct.union(implied).groupBy(*owner, "skill", "layer").agg(F.min("token").alias("via"))


def token_keys(facts: DataFrame, implies: DataFrame) -> DataFrame:
    """(token, key, layer, rank): the keys each distinct token gives."""
    base = facts.select(
        "token",
        F.concat(F.lit("t:"), "token").alias("key"),
        F.lit(0).alias("layer"),
        F.lit(0.0).alias("rank"),
    )
    canonical = facts.select(
        "token", F.concat(F.lit("c:"), "canonical").alias("key"), F.lit(1), F.lit(0.0)
    )
    entailed = facts.join(implies.withColumnRenamed("src", "canonical"), "canonical").select(
        "token", F.concat(F.lit("c:"), "dst").alias("key"), F.lit(2), F.lit(0.0)
    )
    levels = facts.filter(F.col("level").isNotNull()).select(
        "token",
        F.concat(F.lit("p:"), "level.framework").alias("key"),
        F.lit(4),
        F.col("level.rank"),
    )
    return base.union(canonical).union(entailed).union(levels)


def name_keys(names: DataFrame, tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, key, asked_layer, ratio, asked_rank) for each distinct required name.

    `asked_layer` is null where the owner's key decides between identity and
    entailment. Fuzzy keys are added for names that are no proficiency level.
    """
    facts = resolve_names(names, aliases, "name").select(
        "name",
        F.lower(strip("name")).alias("n"),
        "canonical",
        proficiency(F.lower(strip("name"))).alias("level"),
    ).filter(F.col("n") != "")
    none_i, zero, none_d = F.lit(None).cast("int"), F.lit(0.0), F.lit(None).cast("double")
    exact = facts.select(
        "name",
        F.concat(F.lit("t:"), "n").alias("key"),
        F.lit(0).alias("asked_layer"),
        zero.alias("ratio"),
        none_d.alias("asked_rank"),
    )
    identity = facts.select("name", F.concat(F.lit("c:"), "canonical"), none_i, zero, none_d)
    levels = facts.filter(F.col("level").isNotNull()).select(
        "name", F.concat(F.lit("p:"), "level.framework"), F.lit(4), zero, F.col("level.rank")
    )
    plain = facts.filter(F.col("level").isNull())
    near = fuzzy_pairs(plain.select(F.col("n").alias("name")), tokens.select(F.col("token").alias("name")))
    fuzzy = plain.join(near.filter("a <> b"), plain["n"] == near["a"]).select(
        "name", F.concat(F.lit("t:"), "b"), F.lit(3), "ratio", none_d
    )
    return exact.union(identity).union(levels).union(fuzzy)


def _layer() -> Column:
    return F.coalesce("asked_layer", "layer")


def _is_met() -> Column:
    return (_layer() != 4) | (F.col("rank") >= F.col("asked_rank"))


def ask_classes(asked: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that ask for the same keys form one class: (name, class), (class, key, asked_rank).

    Where only credit counts, "Node.js" and "nodejs" need matching once. Keys no
    token gives are left out, and so are raw tokens whose own keys already include
    the name's canonical skill. Names left without keys cannot be met by anyone.
    Works on the vocabulary, not on candidates.
    """
    live = asked.select("name", "key", "asked_rank").distinct().join(given.select("key"), "key", "left_semi")
    raw = live.filter(F.col("key").startswith("t:")).select(
        "name", F.col("key").alias("raw_key"), F.expr("substring(key, 3)").alias("token")
    )
    covered = (
        raw.join(given.select("token", "key"), "token")
        .join(live.filter(F.col("key").startswith("c:")).select("name", "key"), ["name", "key"], "left_semi")
        .select("name", F.col("raw_key").alias("key"))
    )
    needed = live.join(covered, ["name", "key"], "left_anti")
    signature = F.array_sort(F.collect_set(F.struct("key", F.coalesce("asked_rank", F.lit(-1.0)))))
    signed = needed.groupBy("name").agg(signature.alias("signature"))
    classes = signed.groupBy("signature").agg(F.min("name").alias("class"))
    class_of = signed.join(classes, "signature").select("name", "class")
    class_asks = needed.join(classes, needed["name"] == classes["class"]).select("class", "key", "asked_rank")
    return class_of, class_asks


def name_index(given: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, name, layer, order, credit): how well each token meets each name it meets.

    Both sides are joined on their keys here, on the vocabulary, so that candidates need
    one join by token. Earlier layers win, then the higher ratio or level.
    """
    order = F.when(_layer() == 3, -F.col("ratio")).when(_layer() == 4, -F.col("rank")).otherwise(0.0)
    hit = F.struct(_layer().alias("layer"), order.alias("order"), _is_met().cast("double").alias("credit"))
    best = given.join(asked, "key").groupBy("token", "name").agg(F.min(hit).alias("hit"))
    return best.select("token", "name", "hit.layer", "hit.order", "hit.credit")


def class_index(given: DataFrame, class_asks: DataFrame) -> DataFrame:
    """(token, class): the classes of names each token meets."""
    met = F.col("asked_rank").isNull() | (F.col("rank") >= F.col("asked_rank"))
    return given.select("token", "key", "rank").join(class_asks, "key").filter(met).select("token", "class").distinct()


def met_names(tokens: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """Best match per (cv_id, name): layer, via, credit. Names nothing meets are absent.

    Earlier layers win; then the higher ratio or level; then the smaller token.
    """
    result = F.struct("layer", "order", F.col("token").alias("via"), "credit")
    hits = hot_join(tokens.select("cv_id", "token"), index, "token", hot, ["cv_id"])
    return hits.groupBy("cv_id", "name").agg(F.min(result).alias("hit")).select("cv_id", "name", "hit.layer", "hit.via", "hit.credit")


def worked_names(stacks: DataFrame, spans: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """(cv_id, name, months, spans): when a candidate worked in jobs whose own stack meets a name.

    stacks is (cv_id, job_id, token), spans (cv_id, job_id, start_m, end_m).
    """
    used = stack_spans(stacks, spans).filter("start_m is not null")
    met = index.filter("credit = 1").select("token", "name")
    return merged_spans(hot_join(used, met, "token", hot, ["cv_id"]), ["cv_id", "name"])


def stack_spans(stacks: DataFrame, spans: DataFrame) -> DataFrame:
    """(cv_id, token, start_m, end_m), one row per token and start month."""
    return (
        stacks.join(spans, ["cv_id", "job_id"], "left")
        .groupBy("cv_id", "token", "start_m")
        .agg(F.max("end_m").alias("end_m"))
    )


def met_classes(listed: DataFrame, used: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """(cv_id, class, months, spans) of every class a candidate meets.

    `listed` (cv_id, token) counts for the match only, `used` (cv_id, token,
    start_m, end_m) also for the months. One pass serves both.
    """
    none = F.lit(None).cast("int")
    tokens = used.select("cv_id", "token", "start_m", "end_m").union(
        listed.select("cv_id", "token", none, none)
    )
    return merged_spans(hot_join(tokens, index, "token", hot, ["cv_id"]), ["cv_id", "class"])


def requirement_groups(names: DataFrame) -> DataFrame:
    """One row per requirement of a job: (jd_id, tier, req_pos, weight, names, label).

    `names` has one row per name: (jd_id, tier, req_pos, alt_pos, name, weight);
    weight is taken from the representative, alt_pos 0.
    """
    ordered = F.array_sort(F.collect_list(F.struct("alt_pos", "name")))["name"]
    return (
        names.groupBy("jd_id", "tier", "req_pos")
        .agg(F.min_by("weight", "alt_pos").alias("weight"), ordered.alias("names"))
        .withColumn("names", F.array_distinct(F.filter("names", lambda n: n != "")))
        .withColumn("label", F.array_join("names", " / "))
    )


def asked_names(pairs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Applications expanded to required names.

    A job with a large share of all applications is spread by candidate. Many rows come
    of few, so both sides are dealt by job even where one could be broadcast to a few tasks.
    """
    return salted_join(pairs.select("cv_id", "jd_id"), requirements.hint("merge"), ["jd_id"], ["cv_id"])


def evidence(pairs: DataFrame, requirements: DataFrame, groups: DataFrame, met: DataFrame) -> DataFrame:
    """One row per (candidate, job, requirement) with status, layer, via and credit.

    Applications are expanded once, to all names of all requirements; what the candidate
    meets is joined to them. Within an OR-group earlier layers win, then credit, then the
    group's order. Rows of a pair stay together for the sums that follow.
    """
    names = requirements.select("jd_id", "req_pos", "alt_pos", F.when(F.col("name") != "", F.col("name")).alias("name"))
    asked = names.join(groups.select("jd_id", "tier", "req_pos", "weight", "label"), ["jd_id", "req_pos"])
    hit = F.when(F.col("layer").isNotNull(), F.struct("layer", (-F.col("credit")).alias("minus_credit"), "alt_pos", "via"))
    best = (
        asked_names(pairs, asked)
        .join(met, ["cv_id", "name"], "left")
        .repartition("cv_id", "jd_id")
        .groupBy("cv_id", "jd_id", "req_pos")
        .agg(*[F.first(c).alias(c) for c in ("tier", "label", "weight")], F.min(hit).alias("best"))
    )
    layer = F.coalesce("best.layer", F.lit(MISSING))
    credit = F.coalesce(-F.col("best.minus_credit"), F.lit(0.0))
    return best.select(
        "cv_id",
        "jd_id",
        "tier",
        "req_pos",
        "label",
        "weight",
        F.when(credit == 0, "missing").when(layer == 2, "matched_implied").otherwise("matched").alias("status"),
        F.element_at(F.array(*[F.lit(name) for name in LAYERS]), layer + 1).alias("matched_layer"),
        F.coalesce("best.via", F.lit("")).alias("matched_via"),
        credit.alias("credit"),
    )


def group_months(pairs: DataFrame, requirements: DataFrame, worked: DataFrame) -> DataFrame:
    """(cv_id, jd_id, req_pos, months) of required groups with any months."""
    names = requirements.filter((F.col("tier") == "required") & (F.col("name") != "")).select(
        "jd_id", "req_pos", "name"
    )
    return (
        asked_names(pairs, names)
        .join(worked, ["cv_id", "name"])
        .groupBy("cv_id", "jd_id", "req_pos")
        .agg(union_months("months", "spans").alias("months"))
    )


def unknown_skills(tokens: DataFrame, aliases: DataFrame, seen: DataFrame) -> DataFrame:
    """Tokens that are not in the alias table, no proficiency level and no near-spelling.

    `seen` is (cv_id, cv_name, seen_on). Counts distinct candidates per token.
    """
    facts = token_facts(tokens, aliases)
    strange = facts.filter(~F.col("found") & F.col("level").isNull()).select("token")
    strange = strange.withColumn("name", F.lower(strip("token"))).filter(F.col("name") != "")
    vocabulary = (
        aliases.select(F.col("alias").alias("name"))
        .union(aliases.filter("canonical is not null").select("canonical"))
        .distinct()
    )
    near = fuzzy_pairs(strange.select(F.col("token").alias("name")), vocabulary).select(F.col("a").alias("token"))
    novel = strange.join(near, "token", "left_anti")
    # Distinct first, so that a frequent token is counted from partial sums.
    pairs = tokens.join(novel, "token").join(seen, "cv_id").groupBy("name", "cv_name").agg(
        F.max("seen_on").alias("seen_on")
    )
    return pairs.groupBy(F.col("name").alias("skill")).agg(
        F.count("*").alias("cv_count"), F.max("seen_on").alias("last_seen")
    )
