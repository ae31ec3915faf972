"""Receipts, fingerprints, resumption, decisions and set audits.

Freshness goes by content hashes. All of it is joins and grouped sums that Spark plans; a
receipt table is (stage, name, sha256)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold


def content_sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def receipts(df: DataFrame, name: str, text: str, stage: str) -> DataFrame:
    return df.select(F.lit(stage).alias("stage"), F.col(name).alias("name"), content_sha(F.col(text)).alias("sha256"))


def duplicate_groups(df: DataFrame, name: str, text: str) -> DataFrame:
    """(sha256, n, first) of every content."""
    return df.select(name, content_sha(F.col(text)).alias("sha256")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first_name"))


def _digest(df: DataFrame, by: str, order: list[str], value: str, sep: str, name: str) -> DataFrame:
    """SHA-256 over a group's values in order, ``sep`` between them, as a stream: (by, n, name). A group of any size is a
    state of one hash; null values count but add nothing."""

    def start():
        return [None, 0, False, hashlib.sha256()]

    def step(state, row):
        if row is None:
            return state, [(state[0], state[1], state[3].hexdigest())]
        if row["v"] is not None:
            state[3].update(((sep if state[2] else "") + row["v"]).encode())
            state[2] = True
        state[0], state[1] = row[by], state[1] + 1
        return state, []

    kind = df.schema[by].dataType.simpleString().replace("bigint", "long")
    given = df.select(by, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    return fold(given, [by], [f"o{i}" for i in range(len(order))], start, step, f"{by} {kind}, n long, {name} string")


def fingerprint(df: DataFrame, by: str, name: str, text: str) -> DataFrame:
    """Digest over the digests of a group's members in order of name."""
    return _digest(df.select(by, name, content_sha(F.col(text)).alias("sha")), by, [name, "sha"], "sha", ",", "fingerprint")


def set_digest(df: DataFrame, by: str, value: str) -> DataFrame:
    """Digest of a group's distinct values whatever their order."""
    return _digest(df.select(by, F.col(value).cast("string").alias("v")).distinct(), by, ["v"], "v", "\n", "digest")


def pending(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources (name, sha256) without a current receipt in ``done`` (name, sha256, valid): (name, reason)."""
    have = done.groupBy("name").agg(F.max_by(F.struct("sha256", "valid"), F.struct("valid", "sha256")).alias("r"))
    current = done.where("valid").select("name", "sha256").distinct()
    left = sources.join(current, ["name", "sha256"], "left_anti").join(have, "name", "left")
    reason = F.when(F.col("r").isNull(), "missing").when(F.col("r.sha256") != F.col("sha256"), "stale").otherwise("invalid")
    return left.select("name", reason.alias("reason"))


def reusable(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources whose content a valid receipt records."""
    return sources.join(done.where("valid").select("name", "sha256"), ["name", "sha256"], "left_semi")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change) of two snapshots (name, sha256): added, removed or changed."""
    b, a = before.select("name", F.col("sha256").alias("b")), after.select("name", F.col("sha256").alias("a"))
    both = b.join(a, "name", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def same_content(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_missing, n_extra, current): whether two maps of (name, sha256) are equal."""
    n = changes(before, after).agg(F.count_if(F.col("change").isin("removed", "changed")).alias("n_missing"), F.count_if(F.col("change").isin("added", "changed")).alias("n_extra"))
    return n.withColumn("current", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def effective_decisions(candidates: DataFrame, explicit: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with their default ``role`` and confidence, and what an explicit decision (role, override) at
    the same address makes of it. Without override, only candidates of low confidence follow the decision."""
    e = explicit.select(*on, F.col("role").alias("decided"), F.coalesce("override", F.lit(False)).alias("override"))
    both = candidates.join(e, on, "left")
    takes = F.col("decided").isNotNull() & (F.col("override") | (F.col("confidence") == "low"))
    return both.select(*on, F.when(takes, F.col("decided")).otherwise(F.col("role")).alias("role"), F.when(takes, "explicit").when(F.col("decided").isNotNull(), "kept").otherwise("local").alias("origin"))


def undecided(required: DataFrame, decided: DataFrame, on: list[str]) -> DataFrame:
    return required.select(*on).distinct().join(decided.select(*on).distinct(), on, "left_anti")


def bijection(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Addresses that keep two tables from being one to one: (address, problem)."""
    n = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = n.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    problem = F.when(F.col("r") == 0, "undecided").when(F.col("l") == 0, "unknown").when(F.col("r") > 1, "decided twice").when(F.col("l") > 1, "listed twice")
    return n.withColumn("problem", problem).where("problem is not null").select(*on, "problem")


def union_by_id(parent: DataFrame, approved: DataFrame, key: str, value: str) -> DataFrame:
    """Entries of both, one for each id, and whether an id has two values: (key, value, conflict)."""
    return parent.select(key, value).unionByName(approved.select(key, value)).groupBy(key).agg(F.min(value).alias(value), (F.min(value) != F.max(value)).alias("conflict"))


def missing_numbers(df: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers from 1 to a group's largest that it doesn't have: gaps between neighbours are spelled out."""
    from pyspark.sql import Window

    rows = df.select(by, F.col(number).cast("long").alias("n")).distinct().where("n >= 1")
    w = Window.partitionBy(by).orderBy("n")
    gaps = rows.withColumn("prev", F.coalesce(F.lag("n").over(w), F.lit(0).cast("long"))).where("n - prev > 1")
    return gaps.select(by, F.explode(F.sequence(F.col("prev") + 1, F.col("n") - 1)).alias("missing"))


def progress(df: DataFrame) -> DataFrame:
    """Completeness of scans (book, total, done, failed, empty, allowed: arrays of page numbers)."""
    pages = F.sequence(F.lit(1), F.col("total"))
    missing = F.array_except(F.array_except(pages, F.col("done")), F.col("failed"))
    empty = F.array_except("empty", "allowed")
    whole = (F.size(missing) == 0) & (F.size("failed") == 0) & (F.size(empty) == 0)
    return df.select("book", missing.alias("missing"), F.sort_array("failed").alias("failed"), F.sort_array(empty).alias("unexplained"), whole.alias("complete"))


def lineage(snapshots: DataFrame, head: str, depth: int = 1000) -> DataFrame:
    """Chain of (id, parent) from ``head`` to its root, newest first: (id, depth)."""
    spark = snapshots.sparkSession
    view = f"snapshots_{abs(hash((head, id(snapshots))))}"
    snapshots.select("id", "parent").createOrReplaceTempView(view)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(depth + 10))
    return spark.sql(
        f"with recursive chain(id, parent, depth) as (select id, parent, 0 from {view} where id = :head union all "
        f"select s.id, s.parent, c.depth + 1 from chain c join {view} s on s.id = c.parent) select id, depth from chain",
        {"head": head},
    )


def parts_by_base(names: DataFrame, name: str) -> DataFrame:
    """Part files grouped by what they are parts of: (base, n, names in order of their part numbers, a whole one first)."""
    rows = names.select(T.part_base(F.col(name)).alias("base"), T.part_path(F.col(name)).alias("parts"), F.col(name).alias("name"))
    groups = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("parts", "name"))).alias("m"))
    return groups.select("base", "n", F.transform("m", lambda x: x["name"]).alias("names"))


def reason_counts(pending_rows: DataFrame) -> DataFrame:
    """How many sources wait, for each reason of ``pending``."""
    return pending_rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def same_major(recorded: Column, current: Column) -> Column:
    """Whether two schema versions share their major number; without a recorded one they don't."""
    major = lambda c: F.regexp_extract(F.trim(c.cast("string")), r"^([0-9]+)(?:\..*)?$", 1).try_cast("int")
    return F.coalesce(major(recorded) == major(current), F.lit(False))


#: Kinds of invalid output that keep their own kind and action.
KEPT_KINDS = ("prepared_context", "polish_footnote_semantics")


def review_state(review: DataFrame, missing: DataFrame, invalid: DataFrame, escalations: DataFrame) -> DataFrame:
    """What happens to each signal: (file, kind, action). Missing outputs (file) and invalid ones (file, kind, action) are tried again; so
    are review signals (file, kind), unless their persisted state (file, kind, state) asks for a human."""
    human = escalations.where("state = 'human_review_required'").select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("kind", F.lit("")).alias("kind")).distinct().withColumn("human", F.lit(True))
    r = review.select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("kind", F.lit("")).alias("kind")).join(human, ["file", "kind"], "left")
    r = r.select("file", "kind", F.when(F.col("human"), "ask_human").otherwise("retry_subagent").alias("action"))
    own = F.coalesce(F.col("kind").isin(*KEPT_KINDS) & (F.col("action") != ""), F.lit(False))
    bad = invalid.select("file", F.when(own, F.col("kind")).otherwise("invalid_output").alias("kind"), F.when(own, F.col("action")).otherwise("retry_subagent").alias("action"))
    return r.unionByName(missing.select("file", F.lit("missing_output").alias("kind"), F.lit("retry_subagent").alias("action"))).unionByName(bad)
