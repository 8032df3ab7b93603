"""Calibration, back-tests and model metrics (AGG15-AGG18, AGG22-AGG25, JOIN21-JOIN23, TOP6-TOP8, JOB3-JOB7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import vehicle
from odolith.operators.ranges import running_sums
from odolith.session import cut, ship

KEY = ("vehicle_id", "failure_mode")


def outcomes(opened: DataFrame, failures: DataFrame, horizon_s: float, run_end: float | None = None) -> DataFrame:
    """Opened alerts whose horizon lies in the run, with the first failure of the same vehicle and mode in [ts, ts + horizon]."""
    a = (opened if run_end is None else opened.filter(F.col("ts") <= run_end - horizon_s)).alias("a")
    f = failures.alias("f")
    on = (F.col("a.vehicle_id") == F.col("f.vehicle_id")) & (F.col("a.failure_mode") == F.col("f.failure_mode")) & F.col("f.failure_ts").between(F.col("a.ts"), F.col("a.ts") + horizon_s)
    return a.join(f, on, "left").groupBy(*[F.col(f"a.{c}").alias(c) for c in opened.columns]).agg(F.min("f.failure_ts").alias("next_failure"))


def rule_calibration(outcome: DataFrame, scale: float = 1.0) -> DataFrame:
    """For each rule: eligible and followed alerts, p, its Wilson interval, and hours to failure: median and tenth percentile by nearest rank."""
    hours = (F.col("next_failure") - F.col("ts")) * scale / 3600
    per = outcome.withColumn("hours", hours).groupBy("rule_code").agg(
        F.count("*").alias("eligible"), F.count("next_failure").alias("followed"), F.median("hours").alias("median_h"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY hours)").alias("p10_h")
    )
    ci = vehicle.wilson(F.col("followed"), F.col("eligible"))
    return per.select("rule_code", "eligible", "followed", F.round(F.col("followed") / F.col("eligible"), 3).alias("p_failure"), ci["low"].alias("ci_low"), ci["high"].alias("ci_high"), F.round("median_h", 1).alias("median_h"), F.round("p10_h", 1).alias("p10_h"))


def pooled_calibration(per_rule: DataFrame, least: int = 10) -> DataFrame:
    """Rules with fewer than `least` eligible alerts take the pooled rate of all, which is also the fallback (null rule)."""
    pool = per_rule.agg(F.round(F.sum("followed") / F.sum("eligible"), 3).alias("pooled"))  # one row
    joined = per_rule.crossJoin(F.broadcast(pool))
    small = F.col("eligible") < least
    rules = joined.select("rule_code", "eligible", F.when(small, F.col("pooled")).otherwise(F.col("p_failure")).alias("p"), F.when(small, "pooled").otherwise("measured").alias("basis"))
    return rules.unionByName(pool.select(F.lit(None).cast("string").alias("rule_code"), F.lit(None).cast("bigint").alias("eligible"), F.col("pooled").alias("p"), F.lit("fallback").alias("basis")))


def holdout_brier(fitted: DataFrame, held: DataFrame) -> DataFrame:
    """One row: alerts, Brier score of the fitted probabilities on held-out counts, that of the base rate, and rules whose fitted value lies in the held-out interval."""
    j = held.alias("h").join(fitted.select("rule_code", F.col("p").alias("fitted_p")), "rule_code")
    base = F.sum("followed") / F.sum("eligible")
    brier = F.sum(F.col("followed") * F.pow(1 - F.col("fitted_p"), 2) + (F.col("eligible") - F.col("followed")) * F.pow(F.col("fitted_p"), 2)) / F.sum("eligible")
    return j.agg(F.sum("eligible").alias("alerts"), brier.alias("brier"), (base * (1 - base)).alias("no_skill"), F.count_if(F.col("fitted_p").between(F.col("ci_low"), F.col("ci_high"))).alias("inside"), F.count("*").alias("rules"))


def true_alerts(opened: DataFrame, episodes: DataFrame) -> DataFrame:
    """Opened alerts inside a fault episode [onset, until] of the same vehicle and mode."""
    a, e = opened.alias("a"), episodes.alias("e")
    return a.join(e, (F.col("a.vehicle_id") == F.col("e.vehicle_id")) & (F.col("a.failure_mode") == F.col("e.failure_mode")) & F.col("a.ts").between(F.col("e.onset_ts"), F.col("e.until_ts")), "left_semi")


def warned(failures: DataFrame, opened: DataFrame) -> DataFrame:
    """Failures with the earliest alert of the same vehicle and mode in [onset, failure), null if none."""
    f, a = failures.alias("f"), opened.alias("a")
    on = (F.col("a.vehicle_id") == F.col("f.vehicle_id")) & (F.col("a.failure_mode") == F.col("f.failure_mode")) & (F.col("a.ts") >= F.col("f.onset_ts")) & (F.col("a.ts") < F.col("f.failure_ts"))
    return f.join(a, on, "left").groupBy(*[F.col(f"f.{c}").alias(c) for c in failures.columns]).agg(F.min("a.ts").alias("first_alert"))


def backtest_modes(failures_warned: DataFrame, scale: float = 1.0) -> DataFrame:
    """Failures, warned, recall and median and least lead hours for each mode and overall (null mode)."""
    lead = (F.col("failure_ts") - F.col("first_alert")) * scale / 3600
    rows = failures_warned.withColumn("lead_h", lead)
    return rows.groupingSets([("failure_mode",), ()], "failure_mode").agg(
        F.count("*").alias("failures"), F.count("first_alert").alias("warned"), F.round(F.count("first_alert") / F.count("*"), 3).alias("recall"), F.round(F.median("lead_h"), 1).alias("median_lead_h"), F.round(F.min("lead_h"), 1).alias("min_lead_h")
    )


def backtest_rules(opened: DataFrame, true_ones: DataFrame) -> DataFrame:
    """Opened alerts, true ones and precision for each rule and overall (null rule)."""
    rows = opened.select("rule_code", F.lit(0).alias("t")).unionByName(true_ones.select("rule_code", F.lit(1).alias("t")))
    n, true = F.count_if(F.col("t") == 0), F.sum("t")
    return rows.groupingSets([("rule_code",), ()], "rule_code").agg(n.alias("opened"), true.alias("true_alerts"), F.round(true / n, 3).alias("precision"))


def _ranked(rows: DataFrame, by: list[str], score: str, label: str, weight: Column) -> DataFrame:
    """Positives and negatives of each distinct score, with those of all higher scores. Scores, not rows, are what is ordered."""
    groups = rows.groupBy(*by, score).agg(F.sum(weight * F.col(label)).alias("pos"), F.sum(weight * (1 - F.col(label))).alias("neg"))
    through = running_sums(groups, by, [F.desc(score)], {"_pos": "pos", "_neg": "neg"})
    return through.select(*groups.columns, (F.col("_pos") - F.col("pos")).alias("pos_above"), (F.col("_neg") - F.col("neg")).alias("neg_above"))


def model_metrics(rows: DataFrame, score: str, label: str, probability: str, by: list[str]) -> DataFrame:
    """Rows, positive rate, average precision, ROC-AUC and Brier score of each group `by`."""
    groups = _ranked(rows, by, score, label, F.lit(1.0))
    tp, all_ = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    total_p, total_n = F.sum("pos"), F.sum("neg")
    curve = groups.groupBy(*by).agg((F.sum(F.col("pos") * tp / all_) / total_p).alias("average_precision"), (F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (total_p * total_n)).alias("roc_auc"))
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    plain = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(label).alias("positive_rate"), F.avg(F.pow(p - F.col(label), 2)).alias("brier"))
    return plain.join(curve, by)


def top_share(rows: DataFrame, t: str, score: str, tie: Column, share: float) -> DataFrame:
    """Of each snapshot the max(1, round(share * n)) rows of the highest score; ties by `tie`."""
    tied = rows.withColumns({"_one": F.lit(1), "_tie": tie})
    ordered = running_sums(tied, [t], [F.desc(score), F.asc("_tie")], {"_r": "_one"}, {"_n": "_one"})
    return ordered.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0))).select(*rows.columns)


def capacity_metrics(rows: DataFrame, score: str, share: float, min_lead_s: float, tie: Column | None = None, scale: float = 1.0) -> DataFrame:
    """One row for lists of limited length: mean precision, failures, those listed before, share caught min_lead_s ahead and median best lead."""
    top = top_share(rows, "t", score, F.md5("vehicle_id") if tie is None else tie, share)
    precision = top.groupBy("t").agg(F.avg("label").alias("p")).agg(F.avg("p").alias("mean_precision"), F.count("*").alias("snapshots"))
    best = top.filter("label = 1").groupBy("vehicle_id", "next_failure_ts").agg(F.max(F.col("next_failure_ts") - F.col("t")).alias("lead"))
    caught = best.agg(F.count("*").alias("listed"), F.count_if(F.col("lead") >= min_lead_s).alias("caught"), F.median(F.col("lead") * scale / 3600).alias("median_lead_h"))
    failures = rows.filter("label = 1").select("vehicle_id", "next_failure_ts").distinct().agg(F.count("*").alias("failures"))
    one = precision.crossJoin(caught).crossJoin(failures)  # one row each
    return one.select("snapshots", F.round("mean_precision", 4).alias("mean_precision"), "failures", "listed", F.round(F.col("caught") / F.nullif(F.col("failures"), F.lit(0)), 4).alias("recall_ahead"), F.round("median_lead_h", 1).alias("median_lead_h"))


#: Rows whose weights in all resamples are held at a time.
CHUNK = 8_192


def resample_weights(base: np.ndarray, n: int) -> np.ndarray:
    """One row for each hash and one column for each resample: Poisson(1) draws by inversion of a mixed 32-bit hash."""
    x = (base.astype(np.uint64)[:, None] + np.arange(n, dtype=np.uint64) * np.uint64(2654435769)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    return np.searchsorted(poisson_steps(), (x + 0.5) / 4294967296.0).astype(float)


def poisson_steps() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, 2 ..., as far as 32 bits reach."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


def resampled_precision(rows: DataFrame, score: str, label: str, n: int, seed: int) -> DataFrame:
    """r, ap, neg: average precision and negatives of each of n resamples of whole vehicles.

    Equal rows of a vehicle are counted, then weights are arrays of n numbers, made where they are summed: rows are dealt by
    ranges of score and vehicle, a range passes on its n totals, and then adds up its bins (equal scores) behind the totals
    of the ranges above it, batch by batch. A bin may lie in several ranges, so each range leaves its first and last one open.
    Nothing is multiplied by n, no task holds a range, and the driver sees some n numbers for each range.
    """
    ship(rows.sparkSession)
    base = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("vehicle_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    thin = rows.select(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("score"), F.col(label).cast("double").alias("label"), base.alias("base"))
    thin = thin.groupBy("score", "label", "base").agg(F.count("*").cast("double").alias("times"))
    dealt = cut(thin.repartitionByRange(F.desc("score"), "base").withColumn("_range", F.spark_partition_id()), "scored")

    def chunk_sums(batch: pa.RecordBatch, new: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of positives and negatives of each bin in rows at .. to; new: where bins begin."""
        base, y, times = (batch.column(c)[at:to].to_numpy(zero_copy_only=False) for c in ("base", "label", "times"))
        w = resample_weights(base, n) * times[:, None]
        return np.add.reduceat(w * y[:, None], new), np.add.reduceat(w * (1 - y)[:, None], new)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = batch.sort_by("_range")
            own = batch.column("_range").to_numpy()
            for at in range(0, len(own), CHUNK):
                part = own[at : at + CHUNK]
                new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for k, pos, neg in zip(part[new].tolist(), *chunk_sums(batch, new, at, at + CHUNK)):
                    found[k] = found.get(k, 0.0) + np.stack([pos, neg])
        yield pa.RecordBatch.from_pydict({"_range": pa.array(list(found), pa.int32()), "sums": pa.array([v.ravel().tolist() for v in found.values()], pa.list_(pa.float64()))})

    above, so_far = {}, np.zeros((2, n))
    parts: dict[int, np.ndarray] = {}
    for r in dealt.mapInArrow(totals, "_range int, sums array<double>").collect():  # one row for each range and task that reads it
        parts[r["_range"]] = parts.get(r["_range"], 0.0) + np.array(r.sums).reshape(2, n)
    for k in sorted(parts):
        above[k], so_far = so_far, so_far + parts[k]

    def precision(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range, in order: its first and its last bin, and what the bins between them add."""
        k, first, held, seen, out = None, None, None, None, None

        def closed(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            nonlocal first, out
            if first is None:
                first, pos, neg = (float(scores[0]), np.stack([pos[0], neg[0]])), pos[1:], neg[1:]
                seen[:] += first[1]
            if len(pos):
                tp, fp = seen[0] + np.cumsum(pos, axis=0), seen[1] + np.cumsum(neg, axis=0)
                seen[:] = tp[-1], fp[-1]
                out = out + ratios(pos, tp, fp).sum(axis=0)

        def told() -> pa.RecordBatch:
            one, last = (first, held) if first else (held, None)
            ends = [pa.array([None if x is None else x[0]], pa.float64()) for x in (one, last)] + [pa.array([None if x is None else np.stack(x[1:]).ravel().tolist()], pa.list_(pa.float64())) for x in (one, last)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *ends, pa.array([out.tolist()], pa.list_(pa.float64()))], names=["_range", "first_score", "last_score", "first", "last", "inner"])

        for batch in batches:
            own, s = batch.column("_range").to_numpy(), batch.column("score").to_numpy()
            begins = [0, *(1 + np.flatnonzero(own[1:] != own[:-1])).tolist(), len(own)] if len(own) else [0]
            for lo, hi in zip(begins, begins[1:]):
                if own[lo] != k:
                    if k is not None:
                        yield told()
                    k = int(own[lo])
                    first, held, seen, out = None, None, above[k].copy(), np.zeros(n)
                for at in range(lo, hi, CHUNK):
                    to = min(at + CHUNK, hi)
                    part = s[at:to]
                    new = np.flatnonzero(np.append(True, ~same(part[1:], part[:-1])))
                    pos, neg = chunk_sums(batch, new, at, to)
                    if held is not None and same(held[0], part[0]):
                        pos[0], neg[0] = pos[0] + held[1], neg[0] + held[2]
                    elif held is not None:
                        closed(np.array([held[0]]), held[1][None], held[2][None])
                    if len(new) > 1:
                        closed(part[new], pos[:-1], neg[:-1])
                    held = (float(part[-1]), pos[-1], neg[-1])
        if k is not None:
            yield told()

    ordered = dealt.repartition("_range").sortWithinPartitions("_range", F.desc("score"))
    told = ordered.mapInArrow(precision, "_range int, first_score double, last_score double, first array<double>, last array<double>, inner array<double>").collect()  # one row for each range
    ap, begun = np.zeros(n), None
    for r in sorted(told, key=lambda r: r["_range"]):
        ap = ap + np.array(r.inner)
        one = np.array(r["first"]).reshape(2, n)
        if begun is not None and same(begun[0], r.first_score):
            begun[2] += one
        else:
            ap, begun = ap + bin_share(begun), [r.first_score, above[r["_range"]], one]
        if r["last"] is not None:
            last = np.array(r["last"]).reshape(2, n)
            ap, begun = ap + bin_share(begun), [r.last_score, above[r["_range"]] + parts[r["_range"]] - last, last]
    ap = ap + bin_share(begun)
    found = [(i, float(ap[i] / so_far[0][i]) if so_far[0][i] else None, float(so_far[1][i])) for i in range(n)]
    return rows.sparkSession.createDataFrame(found, "r int, ap double, neg double")


def same(a, b):
    """Whether scores are equal; NaN is equal to NaN."""
    return (a == b) | ((a != a) & (b != b))


def ratios(pos: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.divide(pos * tp, tp + fp, out=np.zeros(pos.shape), where=tp + fp > 0)


def bin_share(whole: list | None) -> np.ndarray | float:
    """What a bin (score, sums of all above it, its own sums) adds to the average precision."""
    return 0.0 if whole is None else ratios(whole[2][0], *(whole[1] + whole[2]))


def bootstrap(rows: DataFrame, a: str, b: str, label: str = "label", n: int = 200, seed: int = 11) -> DataFrame:
    """Interval of AP(a) - AP(b) over n resamples of whole vehicles: a vehicle's weight in a resample is a Poisson(1) draw of its hash."""
    one, two = resampled_precision(rows, a, label, n, seed), resampled_precision(rows, b, label, n, seed)
    both = one.join(two.select("r", F.col("ap").alias("other")), "r").filter("neg > 0 AND ap IS NOT NULL").withColumn("d", F.col("ap") - F.col("other"))
    return both.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.count("*").alias("resamples"))


def no_alert_rate(rows: DataFrame) -> DataFrame:
    """One row: positive rate of rows without an open rule."""
    return rows.agg(F.coalesce(F.avg(F.when(F.col("rules_open") == 0, F.col("label"))), F.lit(0.0)).alias("no_alert_rate"))


def baseline_probability(score: Column, rules_open: Column, rate: Column) -> Column:
    p = score - 0.001 * F.least(rules_open, F.lit(50))
    return F.when(rules_open > 0, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).otherwise(rate)


def split(rows: DataFrame, share: float = 0.8, seed: int = 0, key: str = "vehicle_id") -> DataFrame:
    """`is_train`: by a hash of the vehicle, so no vehicle is on both sides."""
    return rows.withColumn("is_train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) < int(1000 * share))


def best_row_of_each(rows: DataFrame, key: str, score: str, n: int = 5) -> DataFrame:
    """The n highest rows, one of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), score).alias("r")).select("r.*").orderBy(F.desc(score), key).limit(n)


def top_contributions(parts: Column, n: int = 3) -> Column:
    """The n entries (name, value) of the greatest absolute value."""
    key = F.transform(parts, lambda x: F.struct((-F.abs(x["value"])).alias("k"), x["name"].alias("name"), x["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(key), 1, n), lambda x: F.struct(x["name"].alias("name"), F.round(x["value"], 3).alias("value")))


def train_failure_model(rows: DataFrame, numeric: list[str], categorical: list[str], label: str = "label", validation: str = "is_validation", rounds: int = 40, depth: int = 5, seed: int = 7):
    """A pipeline of boosted trees with early stop on the validation rows. Nulls become a fill value and an indicator."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    filled = with_indicators(rows, numeric)
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep")
    inputs = [f"{c}_filled" for c in numeric] + [f"{c}_missing" for c in numeric] + [f"{c}_index" for c in categorical]
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol=validation)
    return Pipeline(stages=[index, VectorAssembler(inputCols=inputs, outputCol="features"), trees]).fit(filled)


def with_indicators(rows: DataFrame, numeric: list[str]) -> DataFrame:
    return rows.withColumns({f"{c}_filled": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric})


def score_fleet(features: DataFrame, model, numeric: list[str], min_events: int = 30, min_minutes: int = 45) -> DataFrame:
    """`probability` to four digits for vehicles with enough data, null for the others, and `sufficient`."""
    from pyspark.ml.functions import vector_to_array

    ok = (F.col("events_long") >= min_events) & (F.col("minutes_long") >= min_minutes)
    scored = model.transform(with_indicators(features, numeric)).withColumn("sufficient", ok)
    return scored.withColumn("probability", F.when(F.col("sufficient"), F.round(vector_to_array("probability")[1], 4)))


def importance(model, names: list[str], spark, top: int = 15) -> DataFrame:
    """Share of the trees' importance of each feature, the highest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    total = sum(values) or 1.0
    return spark.createDataFrame([(n, float(v / total)) for n, v in zip(names, values)], "name string, share double").orderBy(F.desc("share"), "name").limit(top)


def compare(rows: DataFrame, scores: dict[str, str], by: list[str]) -> DataFrame:
    """The metrics of several scores on the same rows, a row for each: `model`, group columns, metrics."""
    out = None
    for name, column in scores.items():
        one = model_metrics(rows, column, "label", column, by).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
