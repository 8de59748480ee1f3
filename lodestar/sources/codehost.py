"""Issues, pull requests and commits of a code host as texts, the cursor that they leave, and batches for an ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fields that are read of an item's JSON.
ITEM = """number bigint, title string, body string, state string, user struct<login:string>, labels array<struct<name:string>>, pull_request string,
updated_at string, sha string, commit struct<message:string,author:struct<name:string>>"""


def texts(items: DataFrame) -> DataFrame:
    """items (kind: issue or commit, repo, item: JSON text) with kind (issue, pull_request, commit), text and updated_at (null for commits).

    An issue that has a pull_request is one. Of bodies 500 characters are shown, of commit messages 300, of hashes 8. Items of another kind
    and items that aren't JSON objects are left out.
    """
    own = items.withColumn("_i", F.from_json("item", ITEM)).where(F.col("kind").isin("issue", "commit") & F.col("item").rlike(r"^\s*\{") & F.col("_i").isNotNull())
    at = lambda name: F.coalesce(F.col(f"_i.{name}"), F.lit(""))
    pull = F.col("_i.pull_request").isNotNull()
    labels = F.array_join(F.transform(F.coalesce("_i.labels", F.array().cast("array<struct<name:string>>")), lambda x: F.coalesce(x["name"], F.lit(""))), ", ")
    repo = F.coalesce("repo", F.lit(""))
    issue = F.concat(F.when(pull, "Pull Request").otherwise("Issue"), F.lit(" #"), F.coalesce(F.col("_i.number").cast("string"), F.lit("")), F.lit(" in "), repo, F.lit(": "), at("title"),
                     F.lit("\nAuthor: "), F.coalesce("_i.user.login", F.lit("unknown")), F.lit(" | State: "), at("state"), F.lit(" | Labels: "), labels, F.lit("\n"), F.substring(at("body"), 1, 500), F.lit("\n"))
    commit = F.concat(F.lit("Commit "), F.substring(at("sha"), 1, 8), F.lit(" in "), repo, F.lit(" by "), F.coalesce("_i.commit.author.name", F.lit("unknown")), F.lit(":\n"), F.substring(at("commit.message"), 1, 300), F.lit("\n"))
    is_commit = F.col("kind") == "commit"
    made = own.withColumns({"text": F.when(is_commit, commit).otherwise(issue), "updated_at": F.when(~is_commit, F.col("_i.updated_at"))})
    return made.withColumn("kind", F.when(is_commit, "commit").when(pull, "pull_request").otherwise("issue")).drop("_i")


def cursors(made: DataFrame, by: str, before: DataFrame) -> DataFrame:
    """by and cursor: the last updated_at among what texts() gave, else the cursor from before (by, cursor)."""
    new = made.groupBy(by).agg(F.max("updated_at").alias("_new"))
    return before.join(new, by, "full").select(by, F.greatest("_new", "cursor").alias("cursor"))


def batches(made: DataFrame, by: str, time: str, key: str, size: int = 20, column: str = "text", between: str = "\n---\n") -> DataFrame:
    """by, batch (from 0), n and text: each source's texts in order of time, then key, so many to a batch.

    Places are counted by day first and within a day after that, so no task orders all of a source that holds most of the rows. A null time comes first.
    """
    start = F.lit("1970-01-01").cast("timestamp")
    own = made.select(by, F.coalesce(F.col(time), start).alias("_t"), F.col(key).alias("_key"), F.col(column).alias("_text")).withColumn("_day", F.to_date("_t"))
    days = own.groupBy(by, "_day").agg(F.count("*").alias("_n"))  # a row for each day
    before = W.partitionBy(by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    offsets = days.select(by, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = own.withColumn("_k", F.row_number().over(W.partitionBy(by, "_day").orderBy("_t", "_key")) - 1).join(offsets, [by, "_day"])
    placed = placed.withColumn("batch", F.floor((F.col("_from") + F.col("_k")) / size))
    held = placed.groupBy(by, "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_t", "_key", "_text"))).alias("_rows"))
    return held.select(by, "batch", "n", F.array_join(F.transform("_rows", lambda r: F.coalesce(r["_text"], F.lit(""))), between).alias("text"))


def item_url(base: Column, kind: Column, since: Column) -> Column:
    """The first page of a repository's issues or commits since a cursor (null: all)."""
    state = F.when(kind == "issue", "issues?state=all&").otherwise("commits?")
    return F.concat(base, F.lit("/"), state, F.lit("per_page=100"), F.coalesce(F.concat(F.lit("&since="), F.url_encode(since)), F.lit("")))
