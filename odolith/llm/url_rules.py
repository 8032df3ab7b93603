"""URL filters: pattern rules indexed by their rarest literal token, so that only candidate rules run as regular expressions.

A rule is a row (rule, pattern, verdict, tier). Patterns read as in ad-block lists: `||` at the start stands for the
start of the host or of one of its parent domains, `|` for the start or end, `*` for any run, `^` for a separator or the
end; everything else is literal. They apply to the host with the path after it; query and fragment play no part.

A literal token is a run of letters and digits that the pattern fully bounds, so any url that fits has it as one of its
own tokens. Each rule is filed under that of its tokens which the fewest distinct urls have; a rule without one is filed
under the empty token, which every url has. Tokens of the urls fetch candidates, the regular expressions of those run,
and of the rules that fit the lowest tier wins, then the longest rule, then block before allow, then the later text.

Scale: equal urls are judged once; tokens are counted in the map tasks and only where a rule has them; tokens that more
than a thousandth of all token rows have are salted, with their rules; copies of a frequent url stay where they are.

Nulls and edges: a null url or one without `://` has an empty host and path, which only patterns that match nothing at
all fit; a null page_id and repeated rows are kept, each with its verdict; very long urls are judged whole; without
rules every url has the default verdict; rules with a null pattern, verdict or rule are left out, and a null tier comes
last; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.llm.graph import FREQUENT, spread_join
from odolith.session import cut

#: Up to so many rules the index is broadcast; beyond, it is joined by salted token.
BROADCAST_RULES = 20_000

TOKEN = "[A-Za-z0-9]+"
#: What a pattern's token may not touch: a further letter or digit, or a wildcard.
BOUND_TOKEN = "(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"
RULES = "rule string, pattern string, verdict string, tier int"

#: Patterns of the method itself: hosts and folders of trackers, link farms, shops of clicks.
PATTERNS = ("||ads-track.", "||ad-track.", "||adserver.", "||spam-farm.", "||link-farm.", "||tracker.", "||tracking.", "/adserver/", "/click-track/", "||*-casino.", "/phishing/", "||*.doubleclick.")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lowered; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def host_rules(spark: SparkSession, rules: list[tuple[str, str]], patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Rules for (verdict, host/path), which fit the host and its subdomains and paths that start so; behind them, patterns that block."""
    rows = [(r, f"||{r}", v, 0) for v, r in rules] + [(p, p, "block", 1) for p in patterns]
    return spark.createDataFrame(rows, RULES)


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict, tier, regex and `tokens`, the literal tokens of the pattern (one empty token if it has none)."""
    p = F.col("pattern")
    opens = F.when(p.startswith("||"), 2).when(p.startswith("|"), 1).otherwise(0)
    closes = F.when(p.endswith("|") & (F.length(p) > opens), 1).otherwise(0)
    body = F.substring(p, opens + 1, F.length(p) - opens - closes)
    # a side without an anchor is open, as if a wildcard stood there
    sides = F.concat(F.when(opens > 0, "^").otherwise("*"), body, F.when(closes > 0, "^").otherwise("*"))
    tokens = F.array_distinct(F.regexp_extract_all(sides, F.lit(BOUND_TOKEN), F.lit(0)))
    literal = F.regexp_replace(body, r"([\\.+?$(){}\[\]|])", r"\\$1")
    loose = F.regexp_replace(F.replace(literal, F.lit("*"), F.lit(".*")), r"\^", r"(?:[^A-Za-z0-9_.%-]|\$)")
    start = F.when(opens == 2, r"^(?:[^/]*\.)?").when(opens == 1, "^").otherwise("")
    regex = F.concat(F.lit("(?s)"), start, loose, F.when(closes > 0, r"\z").otherwise(""))
    kept = rules.filter("rule IS NOT NULL AND pattern IS NOT NULL AND verdict IS NOT NULL")
    return kept.select("rule", "verdict", F.coalesce("tier", F.lit(2**31 - 1)).alias("tier"), regex.alias("regex"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens")).distinct()


def tokens_of(subjects: DataFrame) -> DataFrame:
    """subject, token: each token of a subject once, and the empty one."""
    found = F.array_distinct(F.regexp_extract_all("subject", F.lit(TOKEN), F.lit(0)))
    return subjects.select("subject", F.explode(F.concat(F.array(F.lit("")), found)).alias("token"))


def index(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """token, n (subjects that have it), rule, verdict, tier, regex: each rule under its rarest token (the first of equals)."""
    filed = rules.withColumn("token", F.explode("tokens"))
    counts = tokens_of(subjects).join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rated = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("rule", "verdict", "tier", "regex").agg(F.min(F.struct("n", "token")).alias("r"))
    # what no url has fetches nothing
    return rarest.select("r.token", "r.n", "rule", "verdict", "tier", "regex").filter("n > 0")


def candidates(subjects: DataFrame, indexed: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """subject with each rule that one of its tokens fetches. indexed: as index() gives it, written once."""
    wanted = tokens_of(subjects)
    if indexed.count() <= broadcast_rules:
        return wanted.join(F.broadcast(indexed), "token")
    # a token of more rows than a thousandth of all is split, so at most 1 / FREQUENT tokens have more than one salt
    share = max(1.0, wanted.count() * FREQUENT)
    often = indexed.filter(F.col("n") > share).select("token", F.ceil(F.col("n") / share).cast("int").alias("salts")).distinct()
    salted = wanted.join(F.broadcast(often), "token", "left").withColumn("salt", F.pmod(F.xxhash64("subject"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = indexed.join(F.broadcast(often), "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    return salted.join(spread, ["token", "salt"]).drop("salt")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """The columns `keep`, host, path, rule, tier and verdict of every row; rule and tier are null where no rule fits."""
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("subject", F.concat("host", "path"))
    subjects = cut(rows.groupBy("subject").agg(F.count("*").alias("rows_of_key")), "subjects")
    indexed = cut(index(compiled(rules), subjects), "rules")
    fits = candidates(subjects, indexed, broadcast_rules).filter(F.rlike("subject", F.col("regex")))
    order = F.struct(-F.col("tier").cast("bigint"), F.length("rule"), F.col("verdict") == "block", F.col("rule"))
    best = fits.groupBy("subject").agg(F.max_by(F.struct("rule", "tier", "verdict"), order).alias("b"))
    best = cut(best.join(subjects, "subject").select("subject", "b.rule", "b.tier", "b.verdict", "rows_of_key"), "judged")
    total = subjects.agg(F.sum("rows_of_key")).first()[0] or 0
    judged = spread_join(rows, best, "subject", total, "left")
    return judged.select(*keep, "host", "path", "rule", "tier", F.coalesce("verdict", F.lit(default)).alias("verdict"))
