"""Sources of issue records: JSON files, relational tables, and normalised tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.functions import text as T

SCALARS = ("issue_key", "project_key", "title", "description_text", "issue_type", "priority", "status", "resolution")
TEXT_LISTS = ("components", "affected_versions", "fix_versions")
ID_LISTS = ("linked_issue_ids", "duplicate_issue_ids")
SCHEMA = ", ".join(["issue_id long", *[f"{c} string" for c in SCALARS], *[f"{c} array<string>" for c in (*TEXT_LISTS, "comments")], *[f"{c} array<long>" for c in ID_LISTS]])


class Repository(Protocol):
    def load(self, spark: SparkSession) -> DataFrame: ...


def _texts(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def normalize(issues: DataFrame) -> DataFrame:
    """Metadata and id lists sorted and distinct, without null and blank entries; comments keep order and repeats; null lists are empty."""
    return issues.withColumns({
        **{c: F.array_sort(F.array_distinct(_texts(F.col(c)))) for c in TEXT_LISTS}, "comments": _texts(F.col("comments")),
        **{c: F.array_sort(F.array_distinct(F.coalesce(F.array_compact(c), F.array().cast("array<long>")))) for c in ID_LISTS},
    })


def latest(issues: DataFrame, time: str = "updated_at") -> DataFrame:
    """The newest row of every issue_id (null times are oldest, equal times go to the larger status, then title); one partial aggregate."""
    columns = issues.columns
    newest = issues.groupBy("issue_id").agg(F.max_by(F.struct(*columns), F.struct(F.col(time), F.coalesce("status", F.lit("")), F.coalesce("title", F.lit("")))).alias("r"))
    return newest.select("r.*")


def reverse_links(issues: DataFrame) -> DataFrame:
    """Both id lists made symmetric among the loaded records; ids of records that are not loaded stay on their own side."""
    out = issues
    for field in ID_LISTS:
        pairs = issues.select("issue_id", F.explode(field).alias("other"))
        both = pairs.unionByName(pairs.select(F.col("other").alias("issue_id"), F.col("issue_id").alias("other")))
        lists = both.groupBy("issue_id").agg(F.array_sort(F.collect_set("other")).alias("__l"))
        out = out.join(lists, "issue_id", "left").withColumn(field, F.coalesce("__l", F.array().cast("array<long>"))).drop("__l")
    return out.select(*issues.columns)


def duplicate_pairs(issues: DataFrame, field: str = "duplicate_issue_ids") -> DataFrame:
    """Distinct unordered pairs (left_issue_id < right_issue_id) that a field names."""
    named = issues.select("issue_id", F.explode(field).alias("other")).where("issue_id IS NOT NULL AND other IS NOT NULL")
    return named.select(F.least("issue_id", "other").alias("left_issue_id"), F.greatest("issue_id", "other").alias("right_issue_id")).distinct()


def first_comments(comments: DataFrame, limit: int, order: str = "creation_date") -> DataFrame:
    """(issue_id, comments): the oldest `limit` comments of each issue that have a text."""
    w = Window.partitionBy("issue_id").orderBy(order, "comment_text")
    kept = comments.where(F.col("comment_text").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return kept.groupBy("issue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "comment_text"))), lambda x: x["comment_text"]).alias("comments"))


def activity_by_day(events: DataFrame, who: str, when: str, what: str) -> DataFrame:
    """(who, day, n_events, kinds): the events of a history per day, with the distinct kinds sorted."""
    return events.groupBy(who, F.to_date(when).alias("day")).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(what)).alias("kinds"))


def _list_field(c: Column) -> Column:
    """A list given as JSON array text, '||'-separated text or one text."""
    as_array = F.from_json(c, "array<string>")
    return _texts(F.when(F.ltrim(c).startswith("["), as_array).when(c.contains("||"), F.split(c, r"\|\|")).when(F.trim(c) != "", F.array(c)))


def decode_json(records: DataFrame) -> DataFrame:
    """Issue records from a column `record` of JSON texts, nested (jira_id + metadata) or flat, with their alternative field names.

    A nested record wins over flat fields. A record without id, key or title raises an error.
    """
    r = F.col("record")
    nested = F.get_json_object(r, "$.metadata").isNotNull() & F.get_json_object(r, "$.jira_id").isNotNull()

    def pick(nested_names: list[str], flat_names: list[str], at_top: list[str] = []) -> Column:  # noqa: B006
        inner = F.coalesce(*[F.get_json_object(r, f"$.metadata.{n}") for n in nested_names], *[F.get_json_object(r, f"$.{n}") for n in at_top], F.lit(None).cast("string"))
        return F.when(nested, inner).otherwise(F.coalesce(*[F.get_json_object(r, f"$.{n}") for n in flat_names], F.lit(None).cast("string")))

    ids = lambda c: F.filter(F.transform(_list_field(c), T.issue_reference), lambda x: x.isNotNull())
    key = pick(["issue_key", "key"], ["issue_key", "key"], ["jira_id"])
    issue_id = T.issue_reference(F.coalesce(pick(["issue_id", "id"], ["issue_id", "id"]), key))
    title = pick(["summary", "title"], ["title"])
    whole = F.when(issue_id.isNotNull() & key.isNotNull() & title.isNotNull(), issue_id).otherwise(F.raise_error(F.lit("issue record without id, key or title")).cast("bigint"))
    same = lambda n: pick([n], [n])
    return normalize(records.select(
        whole.alias("issue_id"), key.alias("issue_key"), same("project_key").alias("project_key"), title.alias("title"),
        F.coalesce(pick(["description", "description_text"], ["description_text", "description"]), F.lit("")).alias("description_text"),
        *[same(c).alias(c) for c in ("issue_type", "priority", "status", "resolution")],
        _list_field(same("components")).alias("components"), _list_field(pick(["affected_versions", "affects_versions"], ["affected_versions"])).alias("affected_versions"),
        _list_field(same("fix_versions")).alias("fix_versions"), _list_field(pick(["comments", "comments_body"], ["comments"])).alias("comments"),
        ids(pick(["linked_issue_ids", "related_issues"], ["linked_issue_ids"])).alias("linked_issue_ids"),
        ids(pick(["duplicate_issue_ids", "duplicate_issues"], ["duplicate_issue_ids"])).alias("duplicate_issue_ids"),
    ))


class JsonRepository:
    """A JSON file or folder: a list of records, {"issues": [...]}, or one record; or one record a line (.jsonl, .ndjson), which many tasks read."""

    def __init__(self, path: str, limit: int | None = None, lines: bool | None = None):
        self.path, self.limit = path, limit
        self.lines = path.lower().endswith((".jsonl", ".ndjson")) if lines is None else lines

    def load(self, spark: SparkSession) -> DataFrame:
        if self.lines:
            records = spark.read.text(self.path).select(F.trim("value").alias("record")).where(F.col("record") != "")
        else:
            whole = spark.read.text(self.path, wholetext=True).select(F.trim("value").alias("v"))
            wrapped = F.get_json_object("v", "$.issues")
            several = F.when(F.col("v").startswith("["), F.col("v")).otherwise(wrapped)
            items = F.when(several.isNotNull(), F.from_json(several, "array<string>")).otherwise(F.array("v"))
            records = whole.select(F.explode(items).alias("record"))
        issues = reverse_links(decode_json(records))
        return issues if self.limit is None else issues.orderBy("issue_id").limit(self.limit)


def from_relational(tables: dict[str, DataFrame], comment_limit: int | None = None, limit: int | None = None) -> DataFrame:
    """Issue records from relational tables: issue, project, issue_component, component, affected_version, fix_version, version, issue_link, comment.

    Issues without project are dropped (inner join); everything else joins outer, with null for empty lists; a limit of
    0 or None is no limit. Link names count as duplicate in any case.
    """
    def names(link: str, key: str, to: str, out: str) -> DataFrame:
        return tables[link].join(tables[to].withColumnRenamed("id", key), key).groupBy("issue_id").agg(F.array_sort(F.collect_set("name")).alias(out))

    links = tables["issue_link"].where(F.col("target_issue_id").isNotNull())
    is_dup = F.lower("name") == "duplicate"
    ties = links.groupBy("issue_id").agg(F.array_sort(F.collect_set(F.when(~is_dup | F.col("name").isNull(), F.col("target_issue_id")))).alias("linked_issue_ids"), F.array_sort(F.collect_set(F.when(is_dup, F.col("target_issue_id")))).alias("duplicate_issue_ids"))
    base = tables["issue"].join(tables["project"].select(F.col("id").alias("project_id"), "project_key"), "project_id").select(
        F.col("id").alias("issue_id"), "issue_key", "project_key", "title", F.coalesce("description_text", "description", F.lit("")).alias("description_text"), F.col("type").alias("issue_type"), "priority", "status", "resolution")
    out = base
    for part in (names("issue_component", "component_id", "component", "components"), names("affected_version", "affected_version_id", "version", "affected_versions"), names("fix_version", "fix_version_id", "version", "fix_versions"), ties):
        out = out.join(part, "issue_id", "left")
    if comment_limit:
        texts = tables["comment"].select("issue_id", F.coalesce("comment_text", "comment").alias("comment_text"), "creation_date")
        out = out.join(first_comments(texts, comment_limit), "issue_id", "left")
    else:
        out = out.withColumn("comments", F.array().cast("array<string>"))
    out = normalize(out).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    return out.orderBy("issue_id").limit(limit) if limit else out


class JdbcRepository:
    """The relational tables over JDBC. Tables that grow with the issues are read by several connections, each a range of ids; columns are pruned and filters pushed down by Spark's JDBC source."""

    TABLES = ("issue", "project", "issue_component", "component", "affected_version", "fix_version", "version", "issue_link", "comment")
    #: The column whose ranges cut a table.
    RANGES = {"issue": "id", "issue_component": "issue_id", "affected_version": "issue_id", "fix_version": "issue_id", "issue_link": "issue_id", "comment": "issue_id"}

    def __init__(self, url: str, properties: dict[str, str], comment_limit: int | None = None, limit: int | None = None, partitions: int = 8):
        self.url, self.properties, self.comment_limit, self.limit, self.partitions = url, properties, comment_limit, limit, partitions

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        options = {}
        if name in self.RANGES and self.partitions > 1:
            column = self.RANGES[name]
            low, high = spark.read.jdbc(self.url, f"(SELECT min({column}) AS low, max({column}) AS high FROM {name}) bounds", properties=self.properties).first()
            if low is not None and low < high:
                options = {"column": column, "lowerBound": int(low), "upperBound": int(high) + 1, "numPartitions": self.partitions}
        found = spark.read.jdbc(self.url, name, properties=self.properties, **options)
        return found.toDF(*[c.lower() for c in found.columns])

    def load(self, spark: SparkSession) -> DataFrame:
        return reverse_links(from_relational({t: self.read(spark, t) for t in self.TABLES}, self.comment_limit, self.limit))


class ParquetRepository:
    """A table of issue records; the newest row of each id."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> DataFrame:
        return normalize(latest(spark.read.parquet(self.path)))


class RestRepository:
    """The tracker's REST interface is not implemented."""

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("reading from the tracker's REST interface is not implemented")


def repository(kind: str, **options) -> Repository:
    """A source by name: json, jdbc (mysql), parquet, rest (jira_api)."""
    kinds = {"json": JsonRepository, "jdbc": JdbcRepository, "mysql": JdbcRepository, "parquet": ParquetRepository, "rest": RestRepository, "jira_api": RestRepository}
    if kind not in kinds:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(kinds)}")
    return kinds[kind](**options)


def search_view(issues: DataFrame, name: str = "issue_search") -> None:
    """Registers the records with nulls of all text columns as ''."""
    issues.fillna("", [c for c in SCALARS if c in issues.columns]).createOrReplaceTempView(name)
