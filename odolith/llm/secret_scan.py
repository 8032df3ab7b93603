"""Secret scan with an incremental blob ledger.

Every version of every file is content-addressed by its SHA-256. The ledger is a Parquet table with a row for each
scanned pair of blob and rule version and the spans found. A run scans only pairs that the ledger lacks, appends them,
and joins the findings back to all rows that hold the blob. A rule whose pattern changes gets a new version and is the
only one to run again. Each distinct text is scanned once, however many rows hold it.

All work is column expressions. Copies of one text meet in the partial aggregation of each task before the shuffle,
and findings, a small part of all blobs, are joined on the digest.

Nulls and edges: a null text is an empty one; a null doc_id is kept; repeated rows each get the findings; an empty
table gives no rows; further columns are ignored. Spans are in code points, end exclusive, matches leftmost and
non-overlapping for each rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.spans import found, written
from odolith.session import scratch_path


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    gate: str | None = None
    #: Least length of a group of the match, tested after matching, as (pattern of the match's end, length).
    least: tuple[str, int] | None = None


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]"
#: Base kinds first, in the order in which they are listed; those after them are further well-known key formats.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, f"{ASSIGN}{VALUE}++", least=(f"^{ASSIGN}", 8)),
    # a run is taken from its first AKIA to its end, so a short match hides no longer one
    Rule("access", 1, "AKIA[A-Z0-9]{12,}+", gate="AKIA"),
    Rule("hex", 1, "[0-9a-f]{32,}+"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", gate="PRIVATE KEY-----"),
    Rule("hosted", 1, "gh[pousr]_[A-Za-z0-9]{36,}+", gate="gh"),
)

LEDGER = "blob string, kind string, version int, spans array<struct<kind:string,lo:int,hi:int>>"


def scan(text: Column, rule: Rule) -> Column:
    gate = F.contains(text, F.lit(rule.gate)) if rule.gate else F.lit(True)
    keep = (lambda m: F.length(F.regexp_replace(m, rule.least[0], "")) >= rule.least[1]) if rule.least else None
    hits = found(text, rule.pattern, gate & text.rlike(rule.pattern), keep)
    return F.transform(hits, lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))


def read_ledger(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no run has written it yet


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger at `path` lacks of versions (blob, text) and append it."""
    spark = versions.sparkSession
    have, want = read_ledger(spark, path), F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    if have is not None:
        done = have.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        versions = versions.join(done, "blob", "left").withColumn("todo", F.array_except(want, F.coalesce("done", F.array().cast("array<string>"))))
        versions = versions.filter(F.size("todo") > 0).select("blob", "text", "todo")
    else:
        versions = versions.select("blob", "text", want.alias("todo"))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    rows = [
        F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), scan(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    found_rows = blobs.select("blob", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("blob", "r.*")
    found_rows.write.mode("append").parquet(path)


def scan_versions(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of versions (doc_id, text) with `blob` and `spans`, sorted by start and then by rule; ledger: its path, new if None."""
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = versions.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))
    update_ledger(rows.select("blob", "text"), ledger, rules)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
    held = spark.read.schema(LEDGER).parquet(ledger).filter(current & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    ordered = F.transform(F.col("spans"), lambda s: F.struct(s["lo"].alias("lo"), rank[s["kind"]].alias("rank"), s["hi"].alias("hi"), s["kind"].alias("kind")))
    held = held.select("blob", F.array_sort(ordered).alias("spans"))
    none = F.array().cast("array<struct<lo:int,rank:int,hi:int,kind:string>>")
    return rows.select("doc_id", "blob").join(held, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def digest(found_rows: DataFrame) -> DataFrame:
    """The report columns of scan_versions()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.filter("spans", partial(of_kind, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found_rows.select("doc_id", *count, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
