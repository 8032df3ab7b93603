"""Spans of regular-expression matches as column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
EMPTY = "array<struct<lo:int,hi:int,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: lo and hi in code points, end exclusive, and the matched string m.

    Starts are running sums of the lengths of what lies between matches and of the matches, taken in blocks,
    so a text with very many matches costs about BLOCK steps for each.
    """
    gaps = F.transform(F.split(text, pattern), F.length)
    rows = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def block(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))

        def step(s: Column, r: Column) -> Column:
            lo = s["at"] + r["g"]
            hi = lo + F.length(r["m"])
            return F.struct(hi.alias("at"), F.concat(s["out"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"), r["m"].alias("m")))).alias("out"))

        return F.aggregate(part, start, step)

    def joined(all_rows: Column) -> Column:
        found = F.filter(all_rows, lambda r: r["m"].isNotNull())
        blocks = let(found, lambda f: F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / BLOCK)), lambda k: block(F.slice(f, (k * BLOCK + 1).cast("int"), BLOCK))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{EMPTY}>").alias("out"))

        def step(s: Column, b: Column) -> Column:
            moved = F.transform(b["out"], lambda x: F.struct((x["lo"] + s["at"]).alias("lo"), (x["hi"] + s["at"]).alias("hi"), x["m"].alias("m")))
            return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(blocks, start, step)["out"])

    return let(rows, lambda r: F.when(F.size(r) < 2, F.array().cast(EMPTY)).otherwise(joined(r)))


def found(text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """matches() where the cheap test `gate` holds and each kept match passes keep(m); else none."""
    hits = matches(text, pattern)
    return F.when(gate, F.filter(hits, lambda x: keep(x["m"])) if keep else hits).otherwise(F.array().cast(EMPTY))


def written(spans: Column) -> Column:
    """kind:lo:hi of structs that have these, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
