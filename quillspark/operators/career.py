"""Career analytics over profiles (role, axis, proficiency): gaps, transitions, trajectories, stages and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.text import top
from quillspark.stages import written


def similarities(profile: DataFrame) -> DataFrame:
    """source, target, cosine, gap: of ordered pairs of roles; gap is what the target has above the source, summed."""
    p = F.col("p_s") * F.col("p_t")
    side = lambda k, x: profile.select(F.col("role").alias(k), "axis", F.col("proficiency").alias(x))
    pairs = side("source", "p_s").join(side("target", "p_t"), "axis").where("source <> target")
    sums = pairs.groupBy("source", "target").agg(
        F.sum(p).alias("st"), F.sum(F.col("p_s") * F.col("p_s")).alias("ss"), F.sum(F.col("p_t") * F.col("p_t")).alias("tt"),
        F.sum(F.greatest(F.lit(0.0), F.col("p_t") - F.col("p_s"))).alias("gap"),
    )
    return sums.select("source", "target", F.coalesce(F.try_divide("st", F.sqrt(F.col("ss") * F.col("tt"))), F.lit(0.0)).alias("cosine"), "gap")


def transitions(profile: DataFrame, least: float = 0.5, most: float = 20.0, keep: int = 2, digits: int = 6) -> DataFrame:
    """source, target, cosine, gap, rank, fallback: of roles that share a dominant axis, the `keep` likest within the
    gap; a source without any has the likest of all other roles as its fallback."""
    dominant = top(profile, ["role"], [F.desc("proficiency"), F.asc("axis")], 2).select("role", "axis")
    side = lambda k: dominant.select(F.col("role").alias(k), "axis")
    shared = side("source").join(side("target"), "axis").where("source <> target").select("source", "target").distinct()
    rounded = similarities(profile).select("source", "target", F.round("cosine", digits).alias("cosine"), F.round("gap", digits).alias("gap"))
    order = [F.desc("cosine"), F.asc("gap"), F.asc("target")]
    near = rounded.join(shared, ["source", "target"]).where((F.col("cosine") >= least) & (F.col("gap") <= most))
    kept = top(near, ["source"], order, keep)
    rest = top(rounded.join(kept.select("source").distinct(), "source", "left_anti"), ["source"], order, 1)
    return kept.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


# Fixed value: what leadership asks for.
LEADERSHIP = {"management": 4.0, "domain_knowledge": 4.0}


def leadership(profile: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """source, target (-1), gap of every role: how far its juniors are from what leadership asks for."""
    need = F.create_map(*[F.lit(x) for kv in (target or LEADERSHIP).items() for x in kv])
    missing = F.greatest(F.lit(0.0), F.try_element_at(need, F.col("axis")) - F.col("junior"))
    return juniors(profile).groupBy(F.col("role").alias("source")).agg(F.round(F.sum(missing), 6).alias("gap")).select("source", F.lit("-1").alias("target"), "gap")


def best_switch(profile: DataFrame, target: dict[str, float] | None = None, **limits) -> DataFrame:
    """source, target, gap: of each role's transitions the one of the least gap, else leadership."""
    found = top(transitions(profile, **limits), ["source"], [F.asc("gap"), F.asc("target")], 1, "nth").select("source", "target", "gap")
    rest = leadership(profile, target).join(found.select("source"), "source", "left_anti")
    return found.unionByName(rest)


def stage_teams(residents: DataFrame, keep: int = 4, support: int = 2) -> DataFrame:
    """stage, role, grade, place of residents (role, stage, members, grade, transversal): the `keep` largest of each
    stage by members (then role), and after them the largest transversal role, at grade `support`, in every stage."""
    own = top(residents.where("not transversal and stage is not null"), ["stage"], [F.desc("members"), F.asc("role")], keep, "place")
    best = residents.where("transversal").agg(F.min_by("role", F.struct(-F.col("members"), "role")).alias("role")).where("role is not null")
    stages = residents.where("stage is not null").select("stage").distinct()
    helpers = stages.crossJoin(F.broadcast(best)).select("stage", "role", F.lit(support).alias("grade"), F.lit(keep + 1).alias("place"))
    return own.select("stage", "role", "grade", "place").unionByName(helpers)


# The share of the peak that a junior has, and the power of the growth curve, by axis.
JUNIOR = {"experimental": 0.45, "domain_knowledge": 0.40, "management": 0.25, "professional_texts": 0.30, "data_analysis": 0.40, "computational": 0.45, "t_profile": 0.40}
GROWTH = {"experimental": 0.7, "domain_knowledge": 1.0, "management": 2.2, "professional_texts": 1.6, "data_analysis": 0.9, "computational": 0.8, "t_profile": 1.0}


def _of_axis(values: dict[str, float], other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("axis")), F.lit(other))


def _two_places(x: Column) -> Column:
    """A value of 0 or more to two places, by its binary value (F.round goes by the shortest decimal: 1.275 to 1.28)."""
    return F.floor(x * 100 + 0.5) / 100


def juniors(profile: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """profile with junior: a share of the proficiency by axis, 1 at least."""
    share = _of_axis(shares or JUNIOR, 0.4)
    return profile.withColumn("junior", F.greatest(F.lit(1.0), _two_places(F.col("proficiency") * share)))


def trajectory(profile: DataFrame, levels: int = 7, shares: dict[str, float] | None = None, powers: dict[str, float] | None = None) -> DataFrame:
    """role, axis, level, value: growth from the junior value to the peak over the levels, by each axis' own curve."""
    t = (F.col("level") - 1) / (levels - 1)
    rows = juniors(profile, shares).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    value = F.col("junior") + (F.col("proficiency") - F.col("junior")) * F.pow(t, _of_axis(powers or GROWTH, 1.0))
    return rows.select("role", "axis", "level", _two_places(value).alias("value"))


def matched(profile: DataFrame, vectors: DataFrame, warmth: float = 0.35, flat: float = 0.3) -> DataFrame:
    """id, role, confidence, level, is_flat: the role whose profile correlates best with each vector (id, axis, value).

    confidence is the softmax share of the best correlation in per cent, level (from 0) the nearest of the role's
    trajectory; a vector whose centred length is below `flat` correlates 0 with all, so the first role wins.
    """
    # vectors are a row each, so neither they nor vectors times roles are sent or shuffled again; of roles there are tens
    axes = profile.agg(F.array_sort(F.collect_set("axis")).alias("axes"))
    by_axis = lambda x: F.transform("axes", lambda a: F.try_element_at(F.map_from_entries(F.collect_list(F.struct("axis", x))), a))
    p = profile.withColumn("pc", F.col("proficiency") - F.avg("proficiency").over(Window.partitionBy("role"))).crossJoin(F.broadcast(axes))
    own = p.groupBy("role", "axes").agg(F.sqrt(F.sum(F.col("pc") * F.col("pc"))).alias("pn"), by_axis("pc").alias("pc"))
    roles = own.groupBy("axes").agg(F.array_sort(F.collect_list(F.struct("role", "pn", "pc"))).alias("roles"))
    ways = trajectory(profile).crossJoin(F.broadcast(axes)).groupBy("role", "level", "axes").agg(by_axis("value").alias("at"))
    levels = ways.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("level", "at"))).alias("levels"))

    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    entries = F.array_sort(F.collect_list(F.struct("axis", F.col("value").cast("double").alias("value"))))
    values = vectors.where("id is not null and value is not null").groupBy("id").agg(entries.alias("x"), F.avg("value").alias("mean"))
    length = F.sqrt(total("x", lambda e: F.pow(e["value"] - F.col("mean"), F.lit(2.0))))
    placed = F.transform("x", lambda e: F.struct((F.array_position("axes", e["axis"]) - 1).cast("int").alias("at"), e["value"].alias("value"), (e["value"] - F.col("mean")).alias("c")))
    rows = values.crossJoin(F.broadcast(roles)).select("id", length.alias("vn"), "roles", F.filter(placed, lambda e: e["at"] >= 0).alias("x"))  # one row

    def likeness(role: Column) -> Column:
        d = total("x", lambda e: F.coalesce(e["c"] * role["pc"][e["at"]], F.lit(0.0)))
        none = (F.col("vn") < flat) | (role["pn"] < 1e-9)
        return F.when(none, 0.0).when(F.exists("x", lambda e: role["pc"][e["at"]].isNotNull()), F.round(d / (F.col("vn") * role["pn"]), 9))

    # written, as filters that the optimizer moves down would compute it again for each role
    scored = written(rows.select("id", "x", "vn", F.transform("roles", likeness).alias("all")), "likeness").withColumn("top", F.array_max("all"))
    # of equal ones the first name
    nth = F.array_position("all", F.col("top")) - 1
    named = scored.select("id", "x", "vn", "top", nth.cast("int").alias("nth"), total("all", lambda r: F.coalesce(F.exp(r / warmth), F.lit(0.0))).alias("all"))
    ordered = roles.select(F.posexplode("roles").alias("nth", "r")).select("nth", F.col("r.role").alias("role")).join(levels, "role")

    def away(level: Column) -> Column:
        squares = total("x", lambda e: F.coalesce(F.pow(e["value"] - level["at"][e["at"]], F.lit(2.0)), F.lit(0.0)))
        shared = F.exists("x", lambda e: level["at"][e["at"]].isNotNull())
        return F.when(shared, F.struct(F.round(F.sqrt(squares), 9).alias("far"), level["level"].alias("level")))

    near = named.join(F.broadcast(ordered), "nth").withColumn("near", F.array_min(F.transform("levels", away))).where("near is not null")
    return near.select(
        "id", "role", F.round(F.exp(F.col("top") / warmth) / F.col("all") * 100).cast("int").alias("confidence"), (F.col("near.level") - 1).alias("level"), (F.col("vn") < flat).alias("is_flat")
    )


def stages(profile: DataFrame, stage_profiles: dict[str, dict[str, float]], transversal: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """role, stage, similarity, transversal: the stage whose profile is likest, of equal ones the first name; roles with
    one of the `transversal` axes among their two dominant ones belong to no stage."""
    rows = [(s, a, float(x)) for s, axes in stage_profiles.items() for a, x in axes.items()]
    table = profile.sparkSession.createDataFrame(rows, "stage string, axis string, need double")
    own = profile.groupBy("role").agg(F.sqrt(F.sum(F.col("proficiency") * F.col("proficiency"))).alias("length"))
    dots = profile.join(F.broadcast(table), "axis").groupBy("role", "stage").agg(F.sum(F.col("proficiency") * F.col("need")).alias("d"))
    need = table.groupBy("stage").agg(F.sqrt(F.sum(F.col("need") * F.col("need"))).alias("n"))
    sims = dots.join(own, "role").join(F.broadcast(need), "stage").select("role", "stage", F.round(F.col("d") / (F.col("length") * F.col("n") + 1e-9), digits).alias("similarity"))
    best = top(sims, ["role"], [F.desc("similarity"), F.asc("stage")], 1)
    dominant = top(profile, ["role"], [F.desc("proficiency"), F.asc("axis")], 2, "nth")
    across = dominant.groupBy("role").agg(F.max(F.col("axis").isin(*transversal) if transversal else F.lit(False)).alias("transversal"))
    of_stage = lambda c: F.when(~F.col("transversal"), F.col(c)).alias(c)
    return best.join(across, "role").select("role", of_stage("stage"), of_stage("similarity"), "transversal")


def coverage(profile: DataFrame, teams: DataFrame, requirements: dict[str, float]) -> DataFrame:
    """team, axis, supply, required, covered: the best of a team (team, role) on each axis against what is required."""
    table = profile.sparkSession.createDataFrame([(a, float(x)) for a, x in requirements.items()], "axis string, required double")
    supply = teams.join(profile, "role").groupBy("team", "axis").agg(F.max("proficiency").alias("supply"))
    return supply.join(F.broadcast(table), "axis").select("team", "axis", "supply", "required", (F.col("supply") >= F.col("required") - 0.01).alias("covered"))


def top_gaps(profile: DataFrame, keep: int = 3, shares: dict[str, float] | None = None) -> DataFrame:
    """role, axis, gap, rank: where a role's juniors are farthest below its own peak."""
    gaps = juniors(profile, shares).select("role", "axis", F.round(F.greatest(F.lit(0.0), F.col("proficiency") - F.col("junior")), 4).alias("gap"))
    return top(gaps.where("gap > 0"), ["role"], [F.desc("gap"), F.asc("axis")], keep)
