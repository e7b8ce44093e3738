"""Release notes from commit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim

#: Categories in order with their commit types, the form of a subject, of a release commit, of a version tag.
CATEGORIES = [("Features", ("feat",)), ("Bug Fixes", ("fix",)), ("Documentation", ("docs",)), ("Maintenance", ("refactor", "perf", "test", "build", "ci", "chore"))]
OTHER = "Other Changes"
SUBJECT = r"(?i)^([a-z]+)(?:\(([^)]+)\))?(!)?:\s+(.+)$"
RELEASE = r"(?i)^(?:release(?:\([^)]*\))?|chore\(release\))!?:\s"
TAG = r"^v?(\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)$"


def parsed_commit(subject: Column) -> Column:
    """``type, scope, breaking, subject`` of a commit's subject line; of type other where it has none."""
    s = js_trim(subject)
    fits = s.rlike(SUBJECT)
    scope = F.regexp_extract(s, SUBJECT, 2)
    return F.struct(
        F.when(fits, F.lower(F.regexp_extract(s, SUBJECT, 1))).otherwise("other").alias("type"), F.when(fits & (scope != ""), scope).alias("scope"),
        (fits & (F.regexp_extract(s, SUBJECT, 3) != "")).alias("breaking"), F.when(fits, js_trim(F.regexp_extract(s, SUBJECT, 4))).otherwise(s).alias("subject"),
    )


def categorize_commits(df: DataFrame) -> DataFrame:
    """Commits ``(repo, pos, hash, subject, ...)`` with ``parsed``, ``category`` and its number; without empty subjects and release commits."""
    shown = df.where((F.coalesce("subject", F.lit("")) != "") & ~js_trim(F.col("subject")).rlike(RELEASE)).withColumn("parsed", parsed_commit(F.col("subject")))
    kind = F.col("parsed.type")
    name = F.coalesce(*(F.when(kind.isin(*types), c) for c, types in CATEGORIES), F.lit(OTHER))
    number = F.coalesce(*(F.when(kind.isin(*types), k) for k, (_, types) in enumerate(CATEGORIES)), F.lit(len(CATEGORIES)))
    return shown.withColumns({"category": name, "category_no": number})


def category_counts(df: DataFrame) -> DataFrame:
    return categorize_commits(df).groupBy("repo", "category").agg(F.count(F.lit(1)).alias("n"))


def release_notes(df: DataFrame, package: Column, version: Column, since: Column, repo_url: Column, footer: str = "<!-- Generated from the commit log. -->") -> DataFrame:
    """``repo, notes``: a Markdown section of each category, commits in log order. The given columns are of ``df`` and constant in a repo."""
    about = F.struct(package.alias("package"), version.alias("version"), since.alias("since"))
    path = F.regexp_extract(F.coalesce(repo_url, F.lit("")), r"(?i)github\.com[/:](.+?)(?:\.git)?$", 1)
    short = F.substring("hash", 1, 7)
    reference = F.when(path != "", F.concat(F.lit("["), short, F.lit("](https://github.com/"), path, F.lit("/commit/"), F.col("hash"), F.lit(")"))).otherwise(short)
    headers = df.groupBy("repo").agg(F.first(about).alias("about"))
    p = F.col("parsed")
    entry = F.concat(F.lit("- "), F.when(p["scope"].isNotNull(), F.concat(F.lit("**"), p["scope"], F.lit(":** "))).otherwise(""), p["subject"], F.when(p["breaking"], " **BREAKING**").otherwise(""), F.lit(" ("), reference, F.lit(")"))
    entries = categorize_commits(df).select("repo", "category_no", "category", "pos", entry.alias("entry"))
    sections = entries.groupBy("repo", "category_no", "category").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "entry")))["entry"], "\n").alias("lines"))
    section = F.concat(F.lit("### "), F.col("category"), F.lit("\n\n"), F.col("lines"), F.lit("\n\n"))
    bodies = sections.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(F.struct("category_no", section.alias("section"))))["section"], "").alias("body"))
    about = F.col("about")
    start = F.when(F.coalesce(about["since"], F.lit("")) != "", F.concat(F.lit("Changes since `"), about["since"], F.lit("`"))).otherwise("Changes since the beginning of the repository")
    body = F.coalesce("body", F.lit("No user-facing changes were found in this range.\n\n"))
    return headers.join(bodies, "repo", "left").select("repo", F.concat(F.lit("## "), about["package"], F.lit(" v"), about["version"], F.lit("\n\n"), start, F.lit("\n\n"), body, F.lit(footer + "\n")).alias("notes"))


def semver(tag: Column) -> Column:
    value = F.regexp_extract(js_trim(tag), TAG, 1)
    return F.when(value != "", value)


def previous_release_tag(tags: DataFrame, to_ref: Column) -> DataFrame:
    """``repo, previous_tag``: of ``tags(repo, pos, tag)``, newest first, the first version that is not ``to_ref``."""
    tag = js_trim(F.col("tag"))
    return tags.where(semver(F.col("tag")).isNotNull() & (tag != to_ref)).groupBy("repo").agg(F.min_by(tag, "pos").alias("previous_tag"))
