"""A generated collection with known groups, for trials at any size; made where it is used, nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("anchor", "duplicate", "related", "hard_negative", "cross_project")
_SUBJECTS = "login export invoice search upload report session calendar".split()
_FAULTS = "hangs,loses data,shows a wrong total,fails after an update,ignores the filter,is slow under load".split(",")
_WAYS = "opening the page,saving the form,importing a file,switching the account".split(",")


#: What a record's status runs through, and how long after its creation each step is taken.
STEPS = ("Needs Triage", "Open", "In Progress", "Resolved")
_AFTER = ("INTERVAL 5 MINUTES", "INTERVAL 6 HOURS", "INTERVAL 2 DAYS")


def _pick(words: list[str], *salt) -> Column:
    """A word chosen by a hash of the columns."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(*salt), F.lit(len(words))) + 1).cast("int"))


def issues(spark: SparkSession, clusters: int, seed: int = 42) -> DataFrame:
    """Five records a cluster, one of each role, with cluster_id and role beside the columns of the source schema.

    The duplicate tells the anchor's story in other words and names it as duplicate; the related record shares the
    component and is linked both ways; the hard negative has the anchor's words but another fault; the last is in
    another project. A third of the clusters are linked to the next one.
    """
    base = spark.range(clusters).withColumnRenamed("id", "cluster_id").select("cluster_id", F.posexplode(F.array(*map(F.lit, ROLES))).alias("place", "role"))
    c, s, role = F.col("cluster_id"), F.lit(seed), F.col("role")
    id_of = lambda cluster, place: cluster * len(ROLES) + place + 1
    subject, way = _pick(_SUBJECTS, c, s), _pick(_WAYS, c, s, F.lit(1))
    fault = F.when(role == "hard_negative", _pick(_FAULTS, c, s, F.lit(2), F.lit(3))).otherwise(_pick(_FAULTS, c, s, F.lit(2)))
    mark = F.concat(F.lit("REF"), F.substring(F.sha2(F.concat_ws("/", c, s), 256), 1, 6))
    project = F.when(role == "cross_project", _pick(["OPS", "WEB"], c, s)).otherwise(_pick(["PAY", "CORE", "APP"], c, s))
    title = F.when(role == "duplicate", F.concat(F.initcap(way), F.lit(": the "), subject, F.lit(" "), fault)).otherwise(F.concat(F.initcap(subject), F.lit(" "), fault, F.lit(" when "), way))
    text = F.concat(F.lit("Since the last release the "), subject, F.lit(" "), fault, F.lit(". It happens when "), way, F.when(role.isin("anchor", "duplicate"), F.concat(F.lit(". Trace "), mark)).otherwise(""), F.lit("."))
    bridge = (F.pmod(F.xxhash64(c, s, F.lit(9)), F.lit(100)) < 35) & (c + 1 < clusters) & (role == "anchor")
    status = F.when(role == "duplicate", "Resolved").otherwise(_pick(list(STEPS[1:]), c, s, F.col("place"), F.lit(5)))
    none = F.array().cast("array<bigint>")
    linked = F.when(role == "anchor", F.array(id_of(c, 2))).when(role == "related", F.array(id_of(c, 0))).otherwise(none)
    return base.select(
        id_of(c, F.col("place")).alias("issue_id"), F.concat(project, F.lit("-"), id_of(c, F.col("place"))).alias("issue_key"), project.alias("project_key"), title.alias("title"), text.alias("description_text"),
        F.lit("Bug").alias("issue_type"), _pick(["Major", "Minor"], c, s, F.col("place")).alias("priority"), status.alias("status"), F.when(status == "Resolved", F.when(role == "duplicate", "Duplicate").otherwise("Fixed")).alias("resolution"),
        F.array(F.when(role == "hard_negative", F.lit("other")).otherwise(subject)).alias("components"), F.array(F.lit("1.0")).alias("affected_versions"), F.array().cast("array<string>").alias("fix_versions"), F.array(F.concat(F.lit("Seen while "), way)).alias("comments"),
        F.concat(linked, F.when(bridge, F.array(id_of(c + 1, 0))).otherwise(none)).alias("linked_issue_ids"),
        F.when(role == "duplicate", F.array(id_of(c, 0))).when(role == "anchor", F.array(id_of(c, 1))).otherwise(none).alias("duplicate_issue_ids"), "cluster_id", "role",
    )


def pair_labels(generated: DataFrame, seed: int = 42) -> DataFrame:
    """(left_issue_id < right_issue_id, label, relationship_type, similarity_band): the anchor with its duplicate, related record and hard negative, and with two records of other clusters chosen at random."""
    anchors = generated.where("role = 'anchor'").select("cluster_id", F.col("issue_id").alias("a"))
    others = generated.where("role <> 'anchor'").select("cluster_id", F.col("issue_id").alias("b"), "role")
    kinds = F.create_map(*map(F.lit, ("duplicate", "duplicate", "related", "linked", "hard_negative", "hard_negative")))
    inside = anchors.join(others.where("role <> 'cross_project'"), "cluster_id").select("a", "b", kinds[F.col("role")].alias("relationship_type"))
    clusters = generated.select("cluster_id").distinct().count()
    step = 1 + F.pmod(F.xxhash64("cluster_id", F.lit(seed)), F.lit(max(1, clusters - 1)))
    far = anchors.withColumns({"cluster_id": F.pmod(F.col("cluster_id") + step, F.lit(max(1, clusters))), "role": F.explode(F.array(F.lit("related"), F.lit("cross_project")))})
    random = far.join(others, ["cluster_id", "role"]).select("a", "b", F.lit("random_negative").alias("relationship_type")) if clusters > 1 else inside.limit(0)
    band = F.when(F.col("relationship_type") == "duplicate", "high").when(F.col("relationship_type") == "linked", "medium").otherwise("low")
    return inside.unionByName(random).select(
        F.least("a", "b").alias("left_issue_id"), F.greatest("a", "b").alias("right_issue_id"), F.col("relationship_type").isin("duplicate", "linked").cast("int").alias("label"), "relationship_type", band.alias("similarity_band"))


def history(generated: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """(issue_id, event_id, author, created, field, from_value, to_value): every change of status up to the record's own, and that of the resolution, in a year from `start`."""
    opened = F.to_timestamp(F.lit(start)) + F.make_dt_interval(days=F.pmod(F.xxhash64("issue_id"), F.lit(365)).cast("int"), hours=F.pmod(F.xxhash64("issue_id", F.lit(1)), F.lit(24)).cast("int"))
    change = lambda k, field, old, new: F.struct(F.lit(k).alias("step"), (opened + F.expr(_AFTER[k - 1])).alias("created"), F.lit(field).alias("field"), old.cast("string").alias("from_value"), new.alias("to_value"))
    reached = F.array_position(F.array(*map(F.lit, STEPS)), F.col("status")) - 1
    steps = [F.when(reached >= k, change(k, "status", F.lit(STEPS[k - 1]), F.lit(STEPS[k]))) for k in range(1, len(STEPS))]
    closed = F.when(F.col("resolution").isNotNull(), change(len(STEPS) - 1, "resolution", F.lit(None), F.col("resolution")))
    rows = generated.select("issue_id", "issue_key", F.explode(F.array_compact(F.array(*steps, closed))).alias("c"))
    author = F.when(F.col("c.step") == 1, "reporter").otherwise(F.concat(F.lit("agent"), F.pmod(F.xxhash64("issue_id"), F.lit(7))))
    return rows.select("issue_id", F.concat("issue_key", F.lit("-h"), "c.step").alias("event_id"), author.alias("author"), "c.created", "c.field", "c.from_value", "c.to_value")


def activity(events: DataFrame) -> DataFrame:
    """(issue_id, day, events): a history() grouped by day, the events of a day in order, each with a description."""
    told = F.concat("author", F.lit(" changed "), "field", F.lit(" from "), F.coalesce("from_value", F.lit("nothing")), F.lit(" to "), "to_value")
    event = F.struct("created", "event_id", "field", "from_value", "to_value", told.alias("description"))
    return events.groupBy("issue_id", F.to_date("created").alias("day")).agg(F.array_sort(F.collect_list(event)).alias("events"))


def as_records(generated: DataFrame) -> DataFrame:
    """(record): the nested JSON form of every record, as sources.issues.decode_json reads it."""
    fields = [F.col("title").alias("summary"), F.col("description_text").alias("description")] + [
        F.col(c) for c in ("issue_id", "project_key", "issue_type", "priority", "status", "resolution", "components", "affected_versions", "fix_versions", "comments")]
    meta = F.struct(*fields, F.col("linked_issue_ids").alias("related_issues"), F.col("duplicate_issue_ids").alias("duplicate_issues"))
    return generated.select(F.to_json(F.struct(F.col("issue_key").alias("jira_id"), meta.alias("metadata"))).alias("record"))
