import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from odolith.functions import catalog
from odolith.operators import detect, evaluate, plan, quality, radar, rollup, serve, windows
from odolith.operators.ranges import running_sums
from odolith.plans import fleet
from odolith.sources import readers, sinks
from odolith.session import scratch_path
from odolith.streaming import processors


def test_verdicts_equal_a_search(spark):
    rng = random.Random(3)
    rows = [(f"v{rng.randrange(3)}", i, max(0, i // 2 + rng.randrange(-12, 6))) for i in range(600)]
    got = {r.arrival: r.verdict for r in windows.dedup_verdict(spark.createDataFrame(rows, "k string, arrival long, seq long"), "k", "arrival", "seq", 8).collect()}
    for k in ("v0", "v1", "v2"):
        own = [(i, seq) for key, i, seq in rows if key == k]
        want = []
        for at, (_, seq) in enumerate(own):
            before = [x for _, x in own[:at]]
            top = max(before, default=None)
            want.append("NEW" if top is None or seq > top else "TOO_OLD" if top - seq >= 8 else "DUPLICATE" if seq in before else "NEW_LATE")
        assert [got[i] for i, _ in own] == want
        # in batches, from the state of the one before
        held, said = np.zeros(0, np.int64), []
        for cut in np.array_split(np.array([x for _, x in own]), 7):
            some, held = processors.verdicts(cut, held, 8)
            said += some.tolist()
        assert said == want and len(held) <= 8


EVENT = {"vehicle_id": "truck-17", "event_type": "PERIODIC", "speed_kmh": 62.0, "ignition_on": True, "coolant_temp_c": 91.0, "engine_rpm": 2480, "lv_battery_v": 13.8, "hv_cell_delta_mv": None, "tyre_fl_kpa": 252.0, "tyre_fr_kpa": 251.0, "tyre_rl_kpa": 254.0, "tyre_rr_kpa": 253.0, "dtc_codes": []}
EVENTS = "vehicle_id string, ts double, arrival long, seq long, event_type string, speed_kmh double, ignition_on boolean, coolant_temp_c double, engine_rpm int, lv_battery_v double, hv_cell_delta_mv int, tyre_fl_kpa double, tyre_fr_kpa double, tyre_rl_kpa double, tyre_rr_kpa double, dtc_codes array<string>"
NAMES = [x.split()[0] for x in EVENTS.split(", ")]
BEGIN = 1700000000.0


def events(spark, changes, step=1.0, vehicle="truck-17"):
    rows = [EVENT | {"vehicle_id": vehicle, "ts": BEGIN + i * step, "arrival": i, "seq": i} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], EVENTS)


def alerts_of(df):
    return [(r.rule_code, r.status, r.opened_seq) for r in sorted(processors.detections_batch(df).filter("kind = 'alert'").collect(), key=lambda r: (r.seq, r.rule_code, r.status))]


def test_detector_episodes(spark):
    heat = events(spark, [{"coolant_temp_c": c} for c in (90.0, 112.0, 112.5, 111.0, 105.0, 104.9, 113.0)])
    assert alerts_of(heat) == [("COOLANT_OVERHEAT", "open", 2), ("COOLANT_OVERHEAT", "cleared", 2), ("COOLANT_OVERHEAT", "open", 6)]
    stop = events(spark, [{}, {"event_type": "BREAKDOWN", "speed_kmh": 3.0}, {"speed_kmh": 0.5}, {"speed_kmh": 0.0}, {"speed_kmh": 1.0}])
    assert alerts_of(stop) == [("VEHICLE_BREAKDOWN", "open", 1), ("VEHICLE_BREAKDOWN", "cleared", 1)]
    warned = events(spark, [{"dtc_codes": ["P0562", "P0563"]}, {}, {"dtc_codes": ["P0562"]}, {"dtc_codes": ["P0562", "P0562"]}, {}, {}, {}, {}], step=200.0)
    assert alerts_of(warned) == [("DTC_P0562", "open", 3), ("DTC_P0562", "cleared", 3)]
    critical = events(spark, [{"dtc_codes": ["P0A80"]}, {}, {}, {}], step=301.0)
    assert alerts_of(critical) == [("DTC_P0A80", "open", 0), ("DTC_P0A80", "cleared", 0)]
    state = processors.detections_batch(events(spark, [{"coolant_temp_c": 120.0, "dtc_codes": ["P0562"]}] * 31)).filter("kind = 'state'").collect()
    # one snapshot each 15 s: a critical alert costs 40, a warning from its third report 15
    assert sorted((r.seq, r.value) for r in state) == [(0, 60.0), (15, 45.0), (30, 45.0)]


def test_detector_statistics(spark):
    """Each statistic says nothing before its warm-up and then what its definition gives."""
    rng, n = np.random.default_rng(6), 140
    cell, rpm = rng.normal(50, 4, n).astype(int), rng.normal(2486, 200, n).astype(int)
    rows = [{"ignition_on": True, "hv_cell_delta_mv": int(c), "engine_rpm": int(r), "coolant_temp_c": 97.0, "tyre_rr_kpa": 253.0 - 0.3 * k} for k, (c, r) in enumerate(zip(cell, rpm))]
    got = {r.seq: json.loads(r.details)["indicators"] for r in processors.detections_batch(events(spark, rows, step=60.0)).filter("kind = 'state'").collect()}
    weights = lambda k, a: np.array([(1 - a) ** k if i == 0 else a * (1 - a) ** (k - i) for i in range(k + 1)])
    for k in (10, 29, 60, n - 1):
        assert ("HV_CELL_IMBALANCE" in got[k]) == (k + 1 >= 30) and ("MISFIRE_ROUGHNESS" in got[k]) == (k + 1 >= 60)
        if k >= 29:
            assert abs(got[k]["HV_CELL_IMBALANCE"] - weights(k, 0.05) @ cell[: k + 1]) < 1e-3
        if k >= 59:
            w, x = weights(k, 0.02), rpm[: k + 1] - 2486.0
            assert abs(got[k]["MISFIRE_ROUGHNESS"] - np.sqrt(w @ x**2 - (w @ x) ** 2)) < 1e-3
        assert ("COOLANT_DRIFT" in got[k]) == (60 * k >= 900)
        if 60 * k >= 900:
            assert abs(got[k]["COOLANT_DRIFT"] - (k - 14) * (97 - 88 - 0.03 * 62 - 4)) < 1e-3
    leak = [r for r in processors.detections_batch(events(spark, rows, step=60.0)).filter("rule_code = 'TYRE_SLOW_LEAK'").collect()]
    told = json.loads(leak[0].details)
    # the gap to the middle of the others grows by 0.3 of 252 a minute
    assert told["tyre"] == 3 and abs(told["leak_rate_pct_per_hour"] - 100 * 60 * 0.3 / 252) < 0.1 and told["estimated_hours_to_critical"] > 0


def test_detector_equals_windows(spark):
    rng = random.Random(5)
    df = events(spark, [{"coolant_temp_c": rng.uniform(95, 120), "dtc_codes": rng.sample(["P0301", "P0217", "P0420", "C1A10"], rng.randrange(3)) if rng.random() < 0.5 else []} for _ in range(200)], step=120.0)
    rules = catalog.rules(spark).filter("rule_code = 'COOLANT_OVERHEAT'")
    a = windows.rule_transitions(df.withColumn("COOLANT_OVERHEAT", F.col("coolant_temp_c")), rules, "vehicle_id", "arrival", "seq", ["COOLANT_OVERHEAT"])
    b = windows.dtc_transitions(df, catalog.dtcs(spark), "vehicle_id", "ts", "arrival", "seq")
    got = sorted([(r.rule_code, r.status, r.opened_seq, r.seq) for r in a.collect()] + [(f"DTC_{r.code}", r.status, r.opened_seq, r.seq) for r in b.collect()])
    want = sorted((r.rule_code, r.status, r.opened_seq, r.seq) for r in processors.detections_batch(df).filter("kind = 'alert'").collect() if r.rule_code == "COOLANT_OVERHEAT" or r.rule_code.startswith("DTC"))
    assert got == want and len(want) > 20


def greedy_reference(rows: list[dict], capacity: dict[tuple[str, int], int], shops: dict[str, list[str]], horizon_days: int = 7) -> dict[str, tuple[str, int]]:
    """The sequential rule over plain lists."""
    out, used = {}, dict.fromkeys(capacity, 0)
    inf = float("inf")
    for r in sorted(rows, key=lambda r: (-r["value"], inf if r["hours_remaining"] is None else r["hours_remaining"], r["vehicle_id"])):
        for slot in ((w, d) for d in range(horizon_days) for w in shops[r["vehicle_id"]]):
            if used.get(slot, 0) < capacity.get(slot, 0):
                used[slot] = used.get(slot, 0) + 1
                out[r["vehicle_id"]] = slot
                break
    return out


def test_schedule_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    for block in (50_000, 7):
        shops = [(t, f"w{t}{j}", rng.uniform(-5, 5), rng.uniform(-5, 5), rng.randrange(1, 3)) for t in ("a", "b") for j in range(4)]
        cands = [(rng.choice("ab"), f"v{i:02d}", "M", float(round(rng.choice([1, 2, 3.5, rng.random() * 5]), 2)), rng.choice([None, 5.0, 60.0, rng.random() * 200]), rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(40)]
        w = spark.createDataFrame(shops, "tenant_id string, workshop_id string, latitude double, longitude double, daily_capacity int")
        c = spark.createDataFrame(cands, "tenant_id string, vehicle_id string, failure_mode string, value double, hours_remaining double, latitude double, longitude double")
        booked = spark.createDataFrame([("wa0", 0, 1), ("wb1", 1, 2)], "workshop_id string, day int, n long")
        near = {}
        for r in plan.nearest_workshops(c, w, 3).orderBy("vehicle_id", "near").collect():
            near.setdefault(r.vehicle_id, []).append(r.workshop_id)
        capacity = {(x[1], d): x[4] - {("wa0", 0): 1, ("wb1", 1): 2}.get((x[1], d), 0) for x in shops for d in range(3)}
        want = greedy_reference([{"value": x[3], "hours_remaining": x[4], "vehicle_id": x[1]} for x in cands], capacity, near, 3)
        got = plan.schedule(c, w, booked, horizon_days=3, block=block)
        assert {r.vehicle_id: (r.workshop_id, r.day) for r in got.collect() if r.workshop_id} == want
        assert 0 < len(want) < len(cands)


def test_planner_reads_details(spark):
    rows = [(1, "open", "M", "2026-01-01 00:00:00", '{"estimated_hours_to_critical": 7.5}'), (2, "open", "M", "2026-01-01 06:00:00", '{"estimated_hours_to_critical": null}'), (3, "open", None, "2026-01-01 06:00:00", "{}"), (4, "resolved", "M", "2026-01-01 06:00:00", "{}"), (5, "open", "M", "2026-01-01 06:00:00", "broken")]
    df = spark.createDataFrame(rows, "alert_id int, status string, failure_mode string, event_ts string, details string").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    got = plan.planner_alerts(df, F.lit("2026-01-01 12:00:00").cast("timestamp")).collect()
    assert [(r.alert_id, r.age_hours, r.estimated_hours_to_critical) for r in got] == [(1, 12.0, 7.5), (2, 6.0, None), (5, 6.0, None)]


def test_radar_finds_the_planted_defect(spark):
    groups = {"p": ("VEGA", "PK5C8", "7.4", "ICE", 240), "q": ("VEGA", "PK5C8", "7.5", "ICE", 160), "r": ("VEGA", "TR4D2", "7.4", "ICE", 320), "s": ("LYRA", "ET9T5", "1.0", "BEV", 500)}
    cohorts = spark.createDataFrame([(f"{g}-{i}", *about) for g, (*about, n) in groups.items() for i in range(n)], "vehicle_id string, oem string, model_code string, firmware string, powertrain string")
    find = lambda rows: radar.signals(radar.tests(radar.affected(spark.createDataFrame(rows, "vehicle_id string, ts double, dtcs array<string>"), cohorts), radar.populations(cohorts)))
    found = find([(f"q-{i}", 7200.0 + 3 * i, ["P0301"]) for i in range(48)])
    assert {(r.level, r.model_code, r.firmware_version) for r in found.collect()} == {("firmware", "PK5C8", "7.5"), ("model", "PK5C8", None)}
    one = radar.backtest(found, "P0301", "PK5C8", "7.5").first()
    assert one.found and one.first_detection == 10800.0 and one.other_signals == 0
    # the same share everywhere, one noisy vehicle, and too few vehicles are no signals
    assert find([(f"{g}-{i}", 9.0, ["P0301"]) for g, n in (("p", 24), ("q", 16), ("r", 32)) for i in range(n)]).count() == 0
    assert find([("q-7", 2.0 * i, ["P0301"]) for i in range(900)]).count() == 0
    assert find([(f"q-{i}", 4.0, ["P0301"]) for i in range(3)]).count() == 0


def test_poisson_signals_are_all_comparisons_with_their_verdict(spark):
    data = "/root/testdata/sf0.01"
    tested = fleet.QUERIES["cohort_baseline"](spark, data)
    got = fleet.QUERIES["poisson_signals"](spark, data).collect()
    assert len(got) == tested.filter("k >= 2 AND k / n >= 1.2 * ((base_k + 0.5) / (base_n + 1))").count()
    assert {r.signal for r in got} == {True, False} and all(r.signal == (r.p_adjusted < 0.2) for r in got)


def test_capacity_case(spark):
    """Three lists of two out of five: their precisions are 1/2, 1/2 and 1; of three failures one is listed an hour ahead or more."""
    failing = {"p": 30_000.0, "r": 5_400.0, "u": 9_000.0}
    lists = {0.0: {"p": 0.8, "q": 0.7, "r": 0.2, "s": 0.1, "u": 0.05}, 3600.0: {"r": 0.9, "s": 0.85, "p": 0.3, "q": 0.2, "u": 0.1}, 7200.0: {"p": 0.95, "u": 0.6, "q": 0.5, "s": 0.4, "r": 0.3}}
    known = {(0.0, "p"), (3600.0, "r"), (3600.0, "p"), (7200.0, "p"), (7200.0, "u")}
    rows = [(t, v, int((t, v) in known), failing[v] if (t, v) in known else None, score) for t, own in lists.items() for v, score in own.items()]
    df = spark.createDataFrame(rows, "t double, vehicle_id string, label int, next_failure_ts double, score double")
    r = evaluate.capacity_metrics(df, "score", 0.4, 3600.0).first()
    assert (r.snapshots, r.mean_precision, r.failures, r.listed, r.recall_ahead, r.median_lead_h) == (3, 0.6667, 3, 3, 0.3333, 0.5)
    p = spark.createDataFrame([(0.31, 0), (0.643, 3), (1.2, 50)], "s double, n int").select(F.round(evaluate.baseline_probability(F.col("s"), F.col("n"), F.lit(0.07)), 6).alias("p"))
    assert [x.p for x in p.collect()] == [0.07, 0.64, 1.0]


def test_resampled_precision_equals_plain_weights(spark):
    """Continuous scores and ties that fill several chunks and ranges, against weights spelled out one by one."""
    rng, n = random.Random(12), 7
    rows = [(f"v{rng.randrange(40)}", rng.choice([0.5, rng.random()]), int(rng.random() < 0.3)) for _ in range(900)]
    evaluate.CHUNK, held = 100, evaluate.CHUNK
    try:
        got = {r.r: r for r in evaluate.resampled_precision(spark.createDataFrame(rows, "vehicle_id string, score double, label int").repartition(5), "score", "label", n, 11).collect()}
    finally:
        evaluate.CHUNK = held
    steps = evaluate.poisson_steps()
    for r in range(n):
        weight = {}
        for v in {x[0] for x in rows}:
            x = (int(hashlib.md5(f"{v}|11".encode()).hexdigest()[:8], 16) + r * 2654435769) % 2**32
            for _ in range(2):
                x = (x ^ (x >> 16)) * 73244475 % 2**32
            weight[v] = sum(s < ((x ^ (x >> 16)) + 0.5) / 2**32 for s in steps)
        tp = seen = total = 0.0
        for score in sorted({x[1] for x in rows}, reverse=True):
            pos, neg = (sum(weight[v] for v, s, y in rows if s == score and y == want) for want in (1, 0))
            tp, seen = tp + pos, seen + pos + neg
            total += pos * tp / seen if seen else 0
        assert abs(got[r].ap - total / tp) < 1e-12
    assert len({r.ap for r in got.values()}) == n


def test_model_trains_and_scores(spark):
    rng = random.Random(1)
    rows = [(f"v{i % 60}", float(i), rng.random(), rng.random() if i % 7 else None, rng.choice("xy"), 40.0, 50) for i in range(500)]
    df = spark.createDataFrame(rows, "vehicle_id string, t double, a double, b double, kind string, events_long double, minutes_long int").withColumn("label", (F.col("a") > 0.7).cast("int"))
    df = evaluate.split(df, 0.7).withColumn("is_validation", ~F.col("is_train"))
    assert df.groupBy("vehicle_id").agg(F.count_distinct("is_train").alias("n")).filter("n > 1").count() == 0
    model = evaluate.train_failure_model(df, ["a", "b"], ["kind"], rounds=5, depth=3)
    scored = evaluate.score_fleet(df, model, ["a", "b"])
    m = evaluate.model_metrics(scored.withColumn("g", F.lit(1)), "probability", "label", "probability", ["g"]).first()
    assert m.roc_auc > 0.95
    names = ["a", "b", "a_missing", "b_missing", "kind"]
    assert evaluate.importance(model, names, spark).first().name == "a"
    top = spark.range(1).select(evaluate.top_contributions(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("p", 0.1), ("q", -3.0), ("r", 2.0), ("s", 0.5))])).alias("x")).first().x
    assert [y.name for y in top] == ["q", "r", "s"]


def test_training_table_looks_only_back(spark):
    ev = events(spark, [{"coolant_temp_c": 80.0 + i} for i in range(300)], step=60.0).withColumn("ts", F.col("ts") - BEGIN).withColumns({c: F.lit(1.0) for c in ("hv_pack_temp_c", "hv_soh_pct", "odometer_km")})
    vehicles = spark.createDataFrame([("truck-17", "M", "ICE", 2024)], "vehicle_id string, model_code string, powertrain string, model_year int")
    alerts = spark.createDataFrame([("truck-17", "R", "f1", "open", "COOLING_FAILURE", 5000.0), ("truck-17", "R", "f1", "cleared", "COOLING_FAILURE", 6000.0)], "vehicle_id string, rule_code string, fingerprint string, status string, failure_mode string, ts double")
    truth = spark.createDataFrame([("truck-17", "FAILURE", "COOLING_FAILURE", 9000.0, 10000.0)], "vehicle_id string, type string, failure_mode string, onset_ts double, failure_ts double")
    rule_p = spark.createDataFrame([("R", 0.7)], "rule_code string, p double")
    got = {r.t: r for r in rollup.training_table(ev, vehicles, alerts, truth, rule_p, 0.0, 18000.0, 0.4, 3600.0, 1200.0).collect()}
    assert min(got) == 3600.0 and max(got) < 14400.0 and not any(10000 <= t < 11200 for t in got)
    assert all((r.label == 1) == (r.t < 10000 <= r.t + 3600) for r in got.values())
    assert all(r.coolant_max_long == 80.0 + r.t / 60 - 1 for r in got.values())
    assert all((r.rules_open == 1) == (5000 < r.t <= 6000) for r in got.values())


def test_snapshots_and_upserts(spark):
    root = scratch_path(spark, "snap")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sinks.replace_snapshot(a, root, "d")
    b = sinks.upsert(sinks.read_snapshot(spark, root, "d"), spark.createDataFrame([(2, "z"), (3, None)], "k int, v string"), ["k"], ["v"])
    sinks.replace_snapshot(b, root, "d")
    assert sorted(map(tuple, sinks.read_snapshot(spark, root, "d").collect())) == [(1, "x"), (2, "z"), (3, None)] and sinks.snapshot_versions(spark, root, "d") == [1, 2]
    calls = []
    make = lambda: calls.append(1) or a
    for _ in range(2):
        sinks.cached_table(spark, f"{root}/cache", {"w": 60}, 3, make)
    assert len(calls) == 1


def test_readers(spark):
    good = '{"schema_version":1,"event_id":"e","seq":5,"speed_kmh":3.5,"extra":1}'
    rows = readers.read_canonical(spark.createDataFrame([(good, "t", 0, 1), ("{oops", "t", 0, 2)], "value string, topic string, partition int, offset long"))
    assert [(r.seq, r.heading_deg, r.odometer_km) for r in sinks.typed_events(rows).collect()] == [(5, 0, 0.0)]
    assert [(r.offset, r.raw) for r in sinks.ingestion_errors(rows).collect()] == [(2, "{oops")]


def test_views_of_a_tenant(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, tenant_id string")
    assert serve.tenant_scope(df, "a").count() == 1 and serve.tenant_scope(df, None).count() == 0
    assert quality.foreign_tenant(df, spark.createDataFrame([(1, "b")], "id int, tenant_id string"), "id").count() == 2


def test_keyset_pages_show_each_row_once(spark):
    rows = [(float(i // 3), i) for i in range(55)]
    df, seen, after = spark.createDataFrame(rows, "ts double, id long"), [], None
    while True:
        page = serve.keyset_page(df, ["ts", "id"], 10, after).orderBy(F.desc("ts"), F.desc("id")).collect()
        seen += [(r.ts, r.id) for r in page]
        if not page[0].more:
            break
        after = (page[-1].ts, page[-1].id)
    assert seen == sorted(rows, reverse=True)


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(5)
    got = {r.o: (r.upto, r.all) for r in running_sums(df, ["g"], [F.desc("o")], {"upto": "x"}, {"all": "x"}).collect()}
    for g, o, _ in rows:
        own = [(p, x or 0) for h, p, x in rows if h == g]
        assert got[o] == (sum(x for p, x in own if p >= o), sum(x for _, x in own))
    assert running_sums(df.limit(0), [], [F.asc("o")], {"upto": "x"}).count() == 0


def test_folds_over_one_long_key(spark):
    rng = random.Random(8)
    rows = [("k", i, i * 60.0, 240.0, 240.0 - i / 40 + rng.random(), 241.0, 240.0 + rng.random()) for i in range(4000)] + [(None, 0, 0.0, 1.0, 1.0, 1.0, 1.0), ("n", 0, None, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, o long, t double, a double, b double, c double, d double")
    mean = {(r.k, r.o): r.ewma for r in windows.ewma(df, "k", "o", "b", 0.1).collect()}
    m = rows[0][4]
    for r in rows[1:4000]:
        m += 0.1 * (r[4] - m)
    assert abs(mean["k", 3999] - m) < 1e-9 and mean[None, 0] == 1.0 and len(mean) == 4002
    kept = sorted(r.o for r in windows.throttled(df.filter("k = 'k'"), "k", "o", "t", 150.0).collect())
    assert kept == list(range(0, 4000, 3))
    leaks = {(r.k, r.o): r for r in windows.tyre_leaks(df, "k", "o", "t", ("a", "b", "c", "d"), 0.02, 7200.0).collect()}
    # the second wheel falls by 1/40 kPa a minute
    hours, short = np.array([r[2] / 3600 for r in rows[:4000]]), np.array([max(0.0, (np.median([r[3], r[5], r[6]]) - r[4]) / np.median([r[3], r[5], r[6]])) for r in rows[:4000]])
    slope = np.polyfit(hours, short, 1, w=np.sqrt(np.exp((hours - hours[-1]) / 2)))[0]
    last = leaks["k", 3999]
    assert last.worst == 1 and abs(last.slope_per_hour - slope) < 1e-6 and len(leaks) == 4001


def test_scores_in_force(spark):
    schema = "vehicle_id string, probability double, model_version string, scored_at long, expires_at long"
    rows = [("a", 0.1, "m1", 1, 50), ("a", 0.2, "m2", 2, 9), ("b", 0.3, "m1", 1, 10), ("c", None, "m1", 1, 90), ("d", 0.4, "m1", 1, None)]
    assert sorted((r.vehicle_id, r.probability) for r in plan.live_scores(spark.createDataFrame(rows, schema), F.lit(10)).collect()) == [("a", 0.1), ("d", 0.4)]


def test_settled_blocks_equal_serving_one_by_one():
    rng = np.random.default_rng(8)
    for n, slots, wishes in [(1, 1, 1), (40, 5, 3), (300, 30, 12), (200, 3, 3), (50, 40, 21)]:
        capacity = rng.integers(1, 4, slots)
        table = np.array([rng.permutation(np.append(np.arange(slots), [-1] * wishes))[:wishes] for _ in range(n)])
        table = np.array([[*[s for s in row if s >= 0], *[-1] * int((row < 0).sum())] for row in table])
        left, want = capacity.copy(), []
        for row in table:
            free = [j for j, s in enumerate(row) if s >= 0 and left[s] > 0]
            want.append(free[0] if free else -1)
            if free:
                left[row[free[0]]] -= 1
        assert plan.settle(table, capacity).tolist() == want


def test_code_windows_equal_a_count(spark):
    """Rows out of order, codes that come and go: transitions from counts taken row by row; and few rows are looked at."""
    rng = random.Random(21)
    rows = []
    for v in "ab":
        t = 0.0
        for i in range(260):
            t += rng.choice([0.0, 20.0, 90.0, 700.0])
            rows.append((v, i, t - (rng.choice([50.0, 900.0]) if rng.random() < 0.08 else 0.0), i * 2, [c for c in ("P0301", "P0217", "P0420", "U0100") if rng.random() < 0.2]))
    df = spark.createDataFrame(rows, "k string, o int, t double, s int, codes array<string>")
    need = {r.code: 1 if r.severity == "critical" else 2 for r in catalog.dtcs(spark).collect() if r.severity != "info"}
    want = set()
    for v in "ab":
        own = [r for r in rows if r[0] == v]
        for code in need:
            opened = None
            for _, o, t, s, _ in own:
                n = sum(code in c for _, _, at, _, c in own if t - 600 <= at <= t)
                if opened is None and n >= need[code]:
                    opened = s
                    want.add((v, o, code, "open", s))
                elif opened is not None and n == 0:
                    want.add((v, o, code, "cleared", opened))
                    opened = None
    got = windows.dtc_transitions(df, catalog.dtcs(spark), "k", "t", "o", "s", "codes", 600, 2)
    assert {(r.k, r.o, r.code, r.status, r.opened_seq) for r in got.collect()} == want and len(want) > 40
    calm = df.withColumn("t", F.col("o") * 100.0)
    needs = spark.createDataFrame(list(need.items()), "code string, need int")
    looked = windows.code_moves(calm, needs, "k", "t", "o", "s", "codes", 600.0).count()
    assert looked <= 2 * calm.select(F.explode("codes")).count()


def test_relational_detector_equals_the_stream_processor(spark):
    """Two vehicles with all kinds of faults, nulls and late rows: alerts, values, details, health, active rules and indicators."""
    rng, frames = random.Random(33), []
    for v in ("truck-1", "truck-2"):
        rows, t = [], 0.0
        for i in range(320):
            t += rng.choice([5.0, 20.0, 60.0, 240.0])
            late = -rng.choice([30.0, 700.0]) if rng.random() < 0.06 else 0.0
            rows.append({
                "ts": BEGIN + t + late, "ignition_on": rng.choice([True, True, True, False, None]) if i % 40 < 6 else True, "speed_kmh": rng.choice([0.0, 30.0, 62.0]), "event_type": "BREAKDOWN" if rng.random() < 0.03 else "PERIODIC",
                "coolant_temp_c": None if rng.random() < 0.05 else rng.uniform(90, 118), "engine_rpm": rng.choice([None, 0, int(rng.uniform(900, 3200))]), "lv_battery_v": rng.uniform(11.5, 12.6), "hv_cell_delta_mv": rng.choice([None, int(rng.uniform(10, 160))]),
                "tyre_fl_kpa": 252.0 - (0.25 * i if v == "truck-1" else 0.0), "tyre_rr_kpa": None if rng.random() < 0.1 else 250.0, "dtc_codes": rng.sample(["P0301", "P0217", "P0420", "C1A10"], rng.randrange(3)) if rng.random() < 0.3 else [],
            })
        frames.append(events(spark, rows, vehicle=v))
    df = frames[0].unionByName(frames[1])
    plain = lambda x: None if x is None else round(float(x), 2)
    key = ("vehicle_id", "seq", "kind", "rule_code", "status", "opened_seq", "severity", "failure_mode")
    want = {tuple(r[k] for k in key): (plain(r.value), json.loads(r.details)) for r in processors.detections_batch(df).collect()}
    found = detect.detections(df).withColumns({f"d_{k}": c for k, c in detect.leak_details(F.col("value"), F.col("wheel"), F.col("slope")).items()}).collect()
    assert {tuple(r[k] for k in key) for r in found} == set(want) and len(found) == len(want)
    assert {r.rule_code for r in found} >= {"TYRE_SLOW_LEAK", "COOLANT_DRIFT", "MISFIRE_ROUGHNESS", "VEHICLE_BREAKDOWN", "DTC_P0301", "DTC_P0217", "HV_CELL_CRITICAL"}
    for r in found:
        value, details = want[tuple(r[k] for k in key)]
        assert abs(r.value - value) < 0.011
        if r.kind == "state":
            assert r.active == details["active"] and set(r.indicators) == set(details["indicators"])
            assert all(abs(r.indicators[k] - x) < 0.0011 for k, x in details["indicators"].items())
        elif details:
            mine = {"occurrences": r.occurrences} if "occurrences" in details else {k: r[f"d_{k}"] for k in details}
            assert all((mine[k] is None) == (x is None) and (x is None or abs(mine[k] - x) <= 0.011 + 0.01 * abs(x)) for k, x in details.items())


def test_a_value_on_a_threshold_falls_as_the_recursion_says(spark):
    """The drift ends four units of the last bit above 60 if summed in turn, and at 60 if the sums before it are merged."""
    low = [67.644, 63.24, 60.492, 60.198, 69.762, 70.956, 67.278, 68.754, 66.522, 71.22, 69.792, 60.03, 70.29, 60.402, 68.754, 62.106, 70.356, 66.498, 63.594, 65.07, 60.342, 61.494, 68.046, 67.764, 67.386, 64.602, 71.964, 71.772, 68.226, 67.806]
    high = [100.506, 99.066, 97.848, 100.662, 99.72, 98.688, 99.534, 102.376]
    changes = [{"coolant_temp_c": t, "speed_kmh": 10.0} for t in [80.0] * 15 + low + high]
    df = events(spark, changes, step=60.0).unionByName(events(spark, changes[:-1], step=60.0, vehicle="truck-18"))
    total = 0.0
    for t in low + high:
        total = max(0.0, total + (t - (88 + 0.03 * 10.0) - 4))
    assert total > 60
    found = detect.detections(df).filter("rule_code = 'COOLANT_DRIFT'").collect()
    assert [(r.vehicle_id, r.seq, r.status) for r in found] == [("truck-17", len(changes) - 1, "open")]


def test_resampled_precision_deals_equal_scores_over_ranges(spark, monkeypatch):
    """Three scores of 600 vehicles: no range holds a score's rows, and the sums of a score that lies in several ranges are whole."""
    rng = np.random.default_rng(8)
    rows = [(f"v{i % 600}", float(rng.integers(3)), int(rng.random() < 0.3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "vehicle_id string, score double, label int")
    ap = lambda: {r.r: (r.ap, r.neg) for r in evaluate.resampled_precision(df, "score", "label", 20, 11).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written, write = [], evaluate.cut
    monkeypatch.setattr(evaluate, "cut", lambda x, name: written.append(write(x, name)) or written[-1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = ap()
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        nine = ap()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(abs(one[k][0] - nine[k][0]) < 1e-12 and one[k][1] == nine[k][1] for k in one) and len(one) == 20
    sizes = [r["count"] for r in written[1].groupBy("_range").count().collect()]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 3
    assert sum(sizes) < len(rows)  # equal rows of a vehicle are one


def test_nearest_workshops_of_many_equal_brute_force(spark):
    """Positions that repeat, poles, places and workshops without a position, one tenant with fewer workshops than asked for; in several groups and tiles."""
    import math

    rng = random.Random(21)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(30)] + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0)]
    shops = [("a", i, *(rng.choice(spots) if i % 11 else (None, 5.0)), i % 3) for i in range(120)] + [("b", 500, 1.0, 1.0, 1), ("b", 501, None, None, 1)]
    cars = [(rng.choice("ab"), i, *(rng.choice(spots) if rng.random() < 0.3 else (rng.uniform(-90, 90), rng.uniform(-180, 180)))) for i in range(150)] + [("a", 900, None, 3.0), ("b", 901, None, None), ("c", 902, 1.0, 1.0)]
    w = spark.createDataFrame(shops, "tenant_id string, workshop_id long, latitude double, longitude double, daily_capacity int")
    c = spark.createDataFrame(cars, "tenant_id string, vehicle_id long, latitude double, longitude double")

    def km(a, b, x, y):
        if None in (a, b, x, y):
            return None
        a, b, x, y = map(math.radians, (a, b, x, y))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2))

    got = {r.vehicle_id: r.shops for r in plan.nearest_list(c, w, 3, places=20, shops=50).collect()}
    assert set(got) == {v for t, v, _, _ in cars if t != "c"}
    for t, v, lat, lon in cars[:-1]:
        far = [(km(lat, lon, x, y), i) for own, i, x, y, _ in shops if own == t]
        want = sorted(far, key=lambda p: (p[0] is None, p[0] or 0.0, p[1]))[:3]
        assert [s.workshop_id for s in got[v]] == [i for _, i in want]
        assert all(s.distance_km == d or abs(s.distance_km - d) < 1e-6 for s, (d, _) in zip(got[v], want))
    # leaves are left out: far fewer than all shops are looked at
    points = plan.sphere(np.array([rng.uniform(-60, 60) for _ in range(3000)]), np.array([rng.uniform(-180, 180) for _ in range(3000)]))
    near = plan.nearest_of(points[:500], points, 3)
    for i in range(0, 500, 25):
        d = ((points - points[i]) ** 2).sum(axis=1)
        assert sorted(d[near[i]].tolist())[:3] == sorted(d.tolist())[:3] and len(near[i]) < 6
