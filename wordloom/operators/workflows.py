"""Lessons and workflows: fingerprints, similarity, clusters and what recurs in them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import fingerprint_tokens, has_repository_path, joined_shingles, names_tool
from wordloom.operators.clusters import leader_clusters
from wordloom.operators.set_join import set_classes, similar_sets
from wordloom.session import cut

#: Tags that name a scope.
GLOBAL_TAGS, USER_TAGS = ("global", "scope:global", "vis:global"), ("user", "scope:user", "vis:user")


def similar_lessons(lessons: DataFrame, key: str, text: str, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """``pairs(a, b, similarity)`` between classes of equal fingerprints (runs of three words), and ``members(key, node)``."""
    grams = joined_shingles(F.col("tokens"), 3, short=True)
    tokens = lessons.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), fingerprint_tokens(text).alias("tokens"))
    classes, members = set_classes(tokens, "key", grams)
    return similar_sets(classes, threshold), members


def lesson_clusters(lessons: DataFrame, key: str, text: str, project: str, when: str) -> DataFrame:
    """``key, anchor, similarity``: each lesson with the earliest lesson it is like, in order of time and key.

    Equal fingerprints stand together: their first member is the class's place in the order. Lessons with a null key or
    text are left out.
    """
    pairs, members = similar_lessons(lessons, key, text)
    members = cut(members)
    timed = members.join(lessons.select(F.col(key).alias("key"), F.col(when).alias("time")), "key")
    first = timed.groupBy("node").agg(F.min(F.struct("time", "key")).alias("f"))
    nodes = cut(first.select("node", F.col("f").alias("place"), F.col("f.key").alias("head")))
    led = leader_clusters(nodes.select("node", "place"), cut(pairs))
    heads = nodes.select(F.col("node").alias("anchor"), "head")
    placed = members.join(led, "node").join(heads, "anchor")
    return placed.select(F.col("key").alias(key), F.col("head").alias("anchor"), "similarity")


def unmarked(lessons: DataFrame, text: str, marks: tuple[str, ...]) -> DataFrame:
    """The lessons whose text holds none of the marks of what was handled at once."""
    for mark in marks:
        lessons = lessons.where(~F.coalesce(F.col(text).contains(mark), F.lit(False)))
    return lessons


def without_scope(tags: Column) -> Column:
    """Tags without those that name a scope, in any case; null is like none."""
    listed = F.coalesce(tags, F.array().cast("array<string>"))
    return F.filter(listed, lambda t: ~F.lower(t).isin(*GLOBAL_TAGS, *USER_TAGS))


def _tagged(tags: str | None, names: tuple[str, ...]) -> Column:
    if tags is None:
        return F.lit(False)
    return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).isin(*names))


def cluster_facts(
    clusters: DataFrame, lessons: DataFrame, key: str, text: str, project: str, tags: str | None = None, reasoned: bool = False
) -> DataFrame:
    """``anchor, lessons, projects, reasons, scope, tags``: what each cluster of lesson_clusters() has in common.

    Reasons: it recurs in two projects or more, a member is tagged global, or its anchor names a tool and no member a
    path of a repository. With ``reasoned`` clusters without a reason are left out. The scope is ``user`` if a member is
    tagged so and none global, else ``global``; ``tags`` are all members' in order, without those of scopes.
    """
    about = lessons.select(
        F.col(key).alias("key"), F.col(project).alias("project"), names_tool(text).alias("tool"), has_repository_path(text).alias("local"),
        _tagged(tags, GLOBAL_TAGS).alias("global"), _tagged(tags, USER_TAGS).alias("user"),
        (without_scope(F.col(tags)) if tags else F.array().cast("array<string>")).alias("tags"),
    ).dropDuplicates(["key"])
    rows = clusters.select(F.col(key).alias("key"), "anchor").join(about, "key")
    facts = rows.groupBy("anchor").agg(
        F.count("*").alias("lessons"), F.count_distinct("project").alias("projects"), F.bool_or("global").alias("global"), F.bool_or("user").alias("user"),
        F.bool_or(F.col("tool") & (F.col("key") == F.col("anchor"))).alias("tool"), F.bool_or("local").alias("local"),
    )
    each = rows.select("anchor", F.explode("tags").alias("tag")).where("tag is not null").distinct()
    held = each.groupBy("anchor").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("projects") >= 2, "recurrence"), F.when(F.col("global"), "tagged-global"),
            F.when(F.col("tool") & ~F.col("local"), "portable-tooling"),
        )
    )
    scope = F.when(F.col("user") & ~F.col("global"), "user").otherwise("global")
    told = facts.join(held, "anchor", "left").select(
        "anchor", "lessons", "projects", reasons.alias("reasons"), scope.alias("scope"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")
    )
    return told.where(F.size("reasons") > 0) if reasoned else told


def cluster_evidence(clusters: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``anchor, evidence``: the members of each cluster as (key, similarity to three places), in order of key.

    With ``most`` so many of the smallest keys; they are cut before any list is gathered. Compare two clusters' evidence
    with same_evidence().
    """
    rows = clusters.select("anchor", F.col(key).alias("key"), F.round("similarity", 3).alias("similarity")).distinct()
    if most is not None:
        place = F.row_number().over(Window.partitionBy("anchor").orderBy("key"))
        rows = rows.withColumn("place", place).where(F.col("place") <= most)
    return rows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("key", "similarity"))).alias("evidence"))


def same_evidence(a: Column, b: Column) -> Column:
    """Whether two lists of evidence name the same keys, in whatever order and however often; null is like empty."""
    keys = lambda e: F.array_sort(F.array_distinct(F.transform(F.coalesce(e, F.array()), lambda x: x["key"].cast("string"))))
    return keys(a) == keys(b)


def similar_workflows(workflows: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Pairs of workflows by the mean similarity of prompt and tool shingles: ``pairs(a, b, similarity), one``.

    A pair that reaches the mean reaches it in one of the two sets, so the exact joins of each set give all candidates.
    ``one(key, prompt, tool)`` has a row per workflow with two non-empty sets; of repeated rows the first by hash stands.
    """
    hashed = lambda c: F.array_sort(F.transform(F.array_distinct(F.array_compact(c)), lambda x: F.xxhash64(x)))
    held = workflows.where(F.col("workflow_id").isNotNull()).select(F.col("workflow_id").alias("key"), hashed("prompt_shingles").alias("prompt"), hashed("tool_shingles").alias("tool"))
    filled = held.where(F.exists("prompt", lambda x: x.isNotNull()) & F.exists("tool", lambda x: x.isNotNull()))
    one = cut(filled.dropDuplicates(["key"]))

    def candidates(side: str) -> DataFrame:
        classes, members = set_classes(one.select("key", side), "key", F.col(side))
        members = cut(members)
        met = similar_sets(classes, threshold).select("a", "b")
        same = members.where("key <> node").select(F.col("node").alias("x"), F.col("key").alias("y"))
        left, right = (members.select(F.col("node").alias(n), F.col("key").alias(k)) for n, k in (("a", "x"), ("b", "y")))
        across = met.join(left, "a").join(right, "b").select("x", "y")
        # a mean of one half is reached by one equal set alone, so all of these are results there
        twins = members.withColumnRenamed("key", "x").join(members.withColumnRenamed("key", "y"), "node").where("x < y").select("x", "y")
        return across.union(twins).union(same)

    with ThreadPoolExecutor(2) as both_sides:  # each side is a row of jobs
        found = reduce(DataFrame.union, both_sides.map(candidates, ("prompt", "tool")))
    pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
    sides = [one.select(F.col("key").alias(n), F.col("prompt").alias(f"p{n}"), F.col("tool").alias(f"t{n}")) for n in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    ratio = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    blend = both.select("a", "b", ((ratio("pa", "pb") + ratio("ta", "tb")) / 2).alias("similarity"))
    return blend.where(F.col("similarity") >= threshold), one


def workflow_clusters(workflows: DataFrame) -> DataFrame:
    """``workflow_id, anchor, similarity``: each workflow with the earliest recorded one it is like."""
    pairs, one = similar_workflows(workflows)
    about = workflows.join(one.select(F.col("key").alias("workflow_id")), "workflow_id", "left_semi").dropDuplicates(["workflow_id"])
    nodes = cut(about.select(F.col("workflow_id").alias("node"), F.col("recorded_at").alias("place")))
    return leader_clusters(nodes, cut(pairs)).withColumnRenamed("node", "workflow_id")


def recurring_workflows(workflows: DataFrame, sessions: int = 3, projects: int = 2) -> DataFrame:
    """``anchor, sessions, projects``: clusters of workflows that recur and that no skill covers.

    A cluster recurs with so many workflows or projects; a skill used in at least half of them covers it.
    """
    led = cut(workflow_clusters(workflows).withColumnRenamed("workflow_id", "node"))
    about = workflows.where("workflow_id IS NOT NULL").dropDuplicates(["workflow_id"])
    rows = led.join(about.select(F.col("workflow_id").alias("node"), "project_id", F.array_distinct(F.array_compact("skill_uses.skill")).alias("skills")), "node")
    facts = rows.groupBy("anchor").agg(F.count("*").alias("sessions"), F.count_distinct("project_id").alias("projects"))
    recurs = facts.where((F.col("sessions") >= sessions) | (F.col("projects") >= projects))
    used = rows.select("anchor", F.explode("skills").alias("skill")).groupBy("anchor", "skill").agg(F.count("*").alias("n"))
    covered = used.join(facts, "anchor").where("2 * n >= sessions").select("anchor").distinct()
    return recurs.join(covered, "anchor", "left_anti")


def proposals(workflows: DataFrame) -> DataFrame:
    """``kind, name, sessions``: what both detectors propose: recurring workflows by their anchor, corrected skills by name.

    A skill's sessions are those of all teams and roles.
    """
    recurring = recurring_workflows(workflows).select(F.lit("workflow").alias("kind"), F.col("anchor").alias("name"), "sessions")
    skills = corrected_skills(workflows).groupBy("skill").agg(F.sum("sessions").alias("sessions"))
    return recurring.union(skills.select(F.lit("skill"), "skill", "sessions"))


def corrected_skills(workflows: DataFrame, least: int = 2) -> DataFrame:
    """``skill, team_id, role_id, sessions, corrections``: skills corrected at least so often within a workflow.

    Repeated rows of one workflow count once; null teams and roles are groups of their own.
    """
    one = workflows.where(F.col("workflow_id").isNotNull()).dropDuplicates(["workflow_id"])
    uses = one.select("workflow_id", "team_id", "role_id", F.explode("skill_uses").alias("u"))
    per = uses.where(F.col("u.skill").isNotNull()).groupBy("workflow_id", "team_id", "role_id", F.col("u.skill").alias("skill")).agg(
        F.sum(F.coalesce(F.size("u.corrections"), F.lit(0))).alias("n")
    )
    kept = per.where(F.col("n") >= least)
    return kept.groupBy("skill", "team_id", "role_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("corrections"))
