"""Workshop planning: candidates, values and slots (JOB8-JOB10, JOIN10-JOIN17, AGG9-AGG10, SNK17)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.functions import catalog, vehicle
from odolith.operators.ranges import running_sums
from odolith.operators.windows import latest_version
from odolith.session import cut, ship


def without_active_order(alerts: DataFrame, orders: DataFrame, active: tuple[str, ...] = ("proposed", "scheduled", "in_progress")) -> DataFrame:
    """Alerts whose vehicle and mode have no active order."""
    held = orders.filter(F.col("status").isin(*active)).select("vehicle_id", "failure_mode").distinct()
    return alerts.join(held, ["vehicle_id", "failure_mode"], "left_anti")


def planner_alerts(alerts: DataFrame, now) -> DataFrame:
    """Open alerts with a failure mode: their age in hours, and the hours to critical that their details (JSON) name, if any."""
    opened = alerts.filter((F.col("status") == "open") & F.col("failure_mode").isNotNull())
    hours = F.get_json_object("details", "$.estimated_hours_to_critical").try_cast("double")
    return opened.withColumn("age_hours", vehicle.age_hours(now, F.col("event_ts"))).withColumn("estimated_hours_to_critical", hours)


def booked_slots(orders: DataFrame, today: str, active: tuple[str, ...] = ("scheduled", "in_progress")) -> DataFrame:
    """Orders of each workshop and day from today on."""
    day = F.datediff("scheduled_for", F.lit(today).cast("date"))
    return orders.filter(F.col("status").isin(*active)).groupBy("workshop_id", day.alias("day")).agg(F.count("*").alias("n")).filter("day >= 0")


def candidates(alerts: DataFrame, calibration: DataFrame, fallback_p: float, costs: DataFrame, model_risk: DataFrame | None = None, rules_version: str = "rules-calibrated-v1", fallback_h: float | None = None) -> DataFrame:
    """One row for each vehicle and mode: its riskiest alert (the first of equals by alert_id), the tightest deadline of any, and the value.

    calibration: rule_code, p_failure, p10_h; costs: tenant_id, failure_mode and figures; model_risk: vehicle_id, probability, model_version, as live_scores() gives them.
    """
    # rules are a small table of constants
    rated = alerts.join(F.broadcast(calibration), "rule_code", "left").withColumn("p", F.coalesce("p_failure", F.lit(fallback_p)))
    known = F.when(F.col("p_failure").isNull(), F.lit(fallback_h).cast("double")).otherwise(F.col("p10_h"))
    left = F.coalesce("estimated_hours_to_critical", known) - F.col("age_hours")
    best = F.max_by(F.struct("tenant_id", "alert_id", "rule_code", "severity", "p"), F.struct(F.col("p"), -F.col("alert_id")))
    per = rated.withColumn("_left", left).groupBy("vehicle_id", "failure_mode").agg(best.alias("b"), F.min("_left").alias("hours_remaining")).select("vehicle_id", "failure_mode", "b.*", "hours_remaining")
    if model_risk is not None:
        per = per.join(model_risk.select("vehicle_id", "probability", "model_version"), "vehicle_id", "left")
    else:
        per = per.withColumn("probability", F.lit(None).cast("double")).withColumn("model_version", F.lit(None).cast("string"))
    per = per.join(costs, ["tenant_id", "failure_mode"], "left")
    p = F.coalesce("probability", "p")
    sourced = vehicle.is_sourced(F.col("source"), F.col("unplanned"), F.col("downtime_per_day"))
    avoided = F.when(sourced, vehicle.avoided_cost(p, F.col("planned"), F.col("unplanned"), F.col("downtime_per_day"), F.col("extra_downtime_days")))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in catalog.SEVERITY_WEIGHT.items() for x in kv])[F.col("severity")], F.lit(0.1))
    why = F.when(F.col("probability").isNotNull(), F.format_string("%s: P(breakdown in 7 d) = %.2f; alert %s (%s) names the failure mode", "model_version", "probability", "rule_code", "severity")).otherwise(F.format_string("%s (%s) -> P(fail in 7 d) = %.2f", "rule_code", "severity", "p"))
    cost = F.when(sourced, F.concat(F.lit("expected cost avoided "), F.format_number(avoided, 2), F.lit(" "), F.col("currency"))).otherwise("repair costs not sourced: ranked by risk x severity")
    return per.select(
        "tenant_id", "vehicle_id", "failure_mode", F.col("alert_id").alias("source_alert_id"), "rule_code", "severity", p.alias("p_failure"), "hours_remaining", F.when(sourced, avoided).otherwise(p * weight).alias("value"),
        F.when(sourced, "cost").otherwise("risk_only").alias("value_basis"), avoided.alias("expected_cost_avoided"), F.when(sourced, F.col("currency")).alias("currency"), F.coalesce("model_version", F.lit(rules_version)).alias("model_version"), F.array(why, cost).alias("reasons"),
    )


def live_scores(scores: DataFrame, now: Column) -> DataFrame:
    """For each vehicle its newest score (by scored_at) that has a probability and is in force: expires_at is null or after `now`."""
    held = scores.filter(F.col("probability").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return latest_version(held, ["vehicle_id"], ["scored_at", "model_version"])


def located(rows: DataFrame, live: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows with the live position of their vehicle, else that of its home workshop."""
    pos = lambda df, name: df.select("vehicle_id", F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude")).alias(name))
    joined = rows.join(pos(live, "_live"), "vehicle_id", "left").join(pos(homes, "_home"), "vehicle_id", "left").withColumn("_p", F.coalesce("_live", "_home"))
    return joined.withColumn("latitude", F.col("_p.latitude")).withColumn("longitude", F.col("_p.longitude")).drop("_live", "_home", "_p")


#: Places, and workshops of a tenant, that a task holds at a time; rows of a leaf of either.
PLACES, SHOPS, LEAF = 20_000, 100_000, 32
#: Squared half chords (of the unit sphere) that differ by less are told apart by the exact formula.
CHORD = 1e-13


def sphere(latitude: np.ndarray, longitude: np.ndarray) -> np.ndarray:
    """Points on the unit sphere; the haversine's argument is a quarter of the square of their chord."""
    lat, lon = np.radians(latitude), np.radians(longitude)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers in groups of neighbours, of `size` at most: halved at the median of the widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        p = points[own]
        order = own[np.argpartition(p[:, np.ptp(p, axis=0).argmax()], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return [x for x in out if len(x)]


def nearest_of(places: np.ndarray, shops: np.ndarray, k: int, leaf: int = LEAF) -> list[np.ndarray]:
    """For each place (a point) the numbers of the k nearest shops, and of all that are as near as the k-th to within CHORD.

    Places go leaf by leaf against the leaves of shops in the order of the least distance between their boxes, until no
    leaf that is left can hold a nearer one.
    """
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(places)
    if not len(shops):
        return found
    of = leaves(shops, leaf)
    low, high = np.array([shops[x].min(axis=0) for x in of]), np.array([shops[x].max(axis=0) for x in of])
    for own in leaves(places, leaf):
        p = places[own]
        apart = np.maximum(0.0, np.maximum(low - p.max(axis=0), p.min(axis=0) - high))
        least = (apart**2).sum(axis=1) / 4
        order = np.argsort(least, kind="stable")
        least, at, ids, d = least[order], 0, np.zeros(0, np.int64), np.zeros((len(own), 0))
        worst, step = np.inf, max(1, -(-k // leaf)) * 2
        while at < len(order) and least[at] <= worst + CHORD:
            more = np.concatenate([of[i] for i in order[at : at + step]])
            ids = np.append(ids, more)
            d = np.concatenate([d, ((p[:, None] - shops[more][None]) ** 2).sum(axis=2) / 4], axis=1)
            at += step
            if len(ids) >= k:
                limit = np.partition(d, k - 1, axis=1)[:, k - 1]
                worst = limit.max()
                near = (d <= limit[:, None] + CHORD).any(axis=0)  # what no place can need goes
                ids, d = ids[near], d[:, near]
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(own), np.inf)
        for i, row in zip(own.tolist(), d <= limit[:, None] + CHORD):
            found[i] = ids[row]
    return found


def nearest_list(rows: DataFrame, workshops: DataFrame, k: int = 3, places: int = PLACES, shops: int = SHOPS) -> DataFrame:
    """rows (whose tenant has a workshop) with `shops`, the k workshops of their tenant by distance, ties by workshop_id; by id where the row has no position, and last of all workshops without one.

    Distinct places are dealt in groups of about `places` of a tenant, its workshops in tiles of about `shops`; each group
    meets each tile in a task, which finds the nearest by leaves. The exact formula ranks the few that it returns. Of
    workshops at one position only the k with the lowest ids can be among the nearest.
    """
    ship(rows.sparkSession)
    where = ["tenant_id", "latitude", "longitude"]
    spot = rows.select(*where).distinct()
    site = Window.partitionBy("tenant_id", "latitude", "longitude").orderBy("workshop_id")
    able = workshops.select(*where, "workshop_id", "daily_capacity").withColumn("_r", F.row_number().over(site)).filter(F.col("_r") <= k).drop("_r")
    able = cut(able.select("tenant_id", "workshop_id", F.col("latitude").cast("double").alias("w_lat"), F.col("longitude").cast("double").alias("w_lon"), "daily_capacity"), "workshops")
    spot = cut(spot, "places")
    share = lambda df, most, name: df.groupBy("tenant_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # one row for each tenant
    dealt = share(spot, places, "_groups").join(share(able, shops, "_tiles"), "tenant_id")
    part = lambda columns, n: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spot.join(dealt, "tenant_id").select(*where, part(where, "_groups").alias("_group"), every("_tiles").alias("_tile"))
    right = able.join(dealt, "tenant_id").select(*able.columns, part(["workshop_id"], "_tiles").alias("_tile"), every("_groups").alias("_group"))

    def found(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("workshop_id")
        number = lambda t, c: t.column(c).cast(pa.float64()).combine_chunks()
        plain = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
        lat, lon, w_lat, w_lon = (number(t, c) for t, c in ((mine, "latitude"), (mine, "longitude"), (theirs, "w_lat"), (theirs, "w_lon")))
        given, absent = np.isfinite(plain(lat)) & np.isfinite(plain(lon)), pc.or_(pc.is_null(w_lat), pc.is_null(w_lon)).to_numpy(zero_copy_only=False)
        sound = np.isfinite(plain(w_lat)) & np.isfinite(plain(w_lon))
        # by id where no distance tells: workshops without a position, those with one that is no number, and for places like that any
        odd = np.concatenate([np.flatnonzero(absent)[:k], np.flatnonzero(~absent & ~sound)[:k]])
        any_ = np.unique(np.concatenate([odd, np.flatnonzero(~absent)[:k], np.arange(min(k, len(absent)))]))
        chosen, at = [any_] * len(given), np.flatnonzero(sound)
        own = np.flatnonzero(given)
        for i, near in zip(own.tolist(), nearest_of(sphere(plain(lat)[own], plain(lon)[own]), sphere(plain(w_lat)[at], plain(w_lon)[at]), k)):
            chosen[i] = np.concatenate([at[near], odd])
        sizes = np.array([len(x) for x in chosen], np.int64)
        mine = mine.select(where).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        take = theirs.select(["workshop_id", "w_lat", "w_lon", "daily_capacity"]).take(pa.array(np.concatenate(chosen).astype(np.int64) if len(chosen) else np.zeros(0, np.int64)))
        return pa.table({**{c: mine.column(c) for c in where}, **{c: take.column(c) for c in take.column_names}})

    kind = {f.name: f.dataType.simpleString() for f in (*spot.schema, *able.schema)}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in (*where, "workshop_id", "w_lat", "w_lon", "daily_capacity"))
    keys = ["tenant_id", "_group", "_tile"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, schema)
    there = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    km = F.when(there, vehicle.haversine_km(F.col("latitude"), F.col("longitude"), F.col("w_lat"), F.col("w_lon")))
    ranked = F.array_sort(F.collect_list(F.struct(F.col("_km").isNull().alias("_none"), F.col("_km").alias("distance_km"), "workshop_id", "daily_capacity")))
    lists = met.withColumn("_km", km).groupBy(*where).agg(F.slice(ranked, 1, k).alias("_near"))
    lists = cut(lists.select(*where, F.transform("_near", lambda s: F.struct(s["distance_km"].alias("distance_km"), s["workshop_id"].alias("workshop_id"), s["daily_capacity"].alias("daily_capacity"))).alias("shops")), "near").alias("p")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in where]
    return rows.alias("r").join(lists, same).select("r.*", "p.shops")


def nearest_workshops(rows: DataFrame, workshops: DataFrame, k: int = 3, key: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """nearest_list() with a row for each workshop; `near` counts from 0."""
    return nearest_list(rows, workshops, k).select(*rows.columns, F.posexplode("shops").alias("near", "s")).select(*rows.columns, "near", "s.workshop_id", "s.distance_km", "s.daily_capacity")


#: Candidates of a tenant that are settled in one task.
BLOCK = 50_000


def settle(slots: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """For candidates in the order of priority, each with its slots in the order of its wishes (-1: no more), the place in that list of the slot it gets, -1 if none.

    All propose to their first slot that may still take them, and a slot keeps the best up to its capacity; a full slot
    takes none behind its last, so those skip it. All slots rank alike: the outcome is that of serving one by one.
    """
    n, m = slots.shape
    limit = np.where(capacity > 0, n, 0)  # a slot takes candidates below its limit
    got, waiting = np.full(n, -1), np.arange(n)
    while len(waiting):
        wish = slots[waiting]
        fits = (wish >= 0) & (waiting[:, None] < limit[wish])
        some = fits.any(axis=1)
        waiting, wish = waiting[some], fits[some].argmax(axis=1)
        got[waiting] = wish
        holders = np.flatnonzero(got >= 0)
        slot = slots[holders, got[holders]]
        order = np.lexsort((holders, slot))
        slot, holders = slot[order], holders[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        full = rank == capacity[slot] - 1
        limit[slot[full]] = holders[full]
        waiting = np.sort(holders[rank >= capacity[slot]])
        got[waiting] = -1
    return got


def schedule(cands: DataFrame, workshops: DataFrame, booked: DataFrame, horizon_days: int = 7, k: int = 3, block: int = BLOCK) -> DataFrame:
    """Slots by value: each candidate, in the order of value, deadline and vehicle, gets its earliest free slot, nearest workshop first; later than its deadline only if none is free before.

    Slots belong to one tenant and rank all candidates alike, so the order of priority is cut into blocks of a tenant's
    candidates; a block is settled at once, with the capacity that the blocks before have left, and those that find no
    slot free need no further round. There are as many rounds as blocks of the largest tenant, fewer once all is taken.
    """
    ship(cands.sparkSession)
    prio = ["p_value", "p_hours", "vehicle_id", "failure_mode"]
    rows = cands.withColumn("p_value", -F.col("value")).withColumn("p_hours", F.coalesce("hours_remaining", F.lit(float("inf"))))
    near = nearest_list(rows, workshops, k).select("tenant_id", *prio, "shops").select("tenant_id", *prio, F.col("shops.workshop_id").alias("shops"), F.col("shops.distance_km").alias("km"), F.lit(1).alias("one"))
    ranked = running_sums(near, ["tenant_id"], [F.col(c) for c in prio], {"rank": "one"})
    ranked = cut(ranked.withColumn("block", F.floor((F.col("rank") - 1) / block)), "ranked")
    days = workshops.select("tenant_id", "workshop_id", "daily_capacity", F.explode(F.sequence(F.lit(0), F.lit(horizon_days - 1))).alias("day"))
    left = days.join(booked, ["workshop_id", "day"], "left").select("tenant_id", "workshop_id", "day", (F.col("daily_capacity") - F.coalesce("n", F.lit(0))).cast("int").alias("free"))
    left, given = cut(left.filter("free > 0"), "capacity"), None
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("tenant_id", "vehicle_id", "failure_mode")}
    shop = workshops.schema["workshop_id"].dataType.simpleString()

    def settled(mine: pa.Table, free: pa.Table) -> pa.Table:
        mine = mine.sort_by("rank")
        lists, km = mine.column("shops").combine_chunks(), mine.column("km").combine_chunks().flatten()
        offsets, names = np.asarray(lists.offsets), lists.flatten()
        sizes = np.diff(offsets)
        # slots as numbers: the place of (workshop, day) in the capacity table
        shops = free.column("workshop_id").combine_chunks().dictionary_encode()
        table = np.full((horizon_days, len(shops.dictionary) + 1), -1)
        table[free.column("day").to_numpy(), np.asarray(shops.indices)] = np.arange(free.num_rows)
        code = pc.fill_null(pc.index_in(names, shops.dictionary), len(shops.dictionary)).to_numpy(zero_copy_only=False)
        wide = np.full((len(sizes), k), len(shops.dictionary))
        wide[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(code)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = code
        wishes = table[:, wide].transpose(1, 0, 2).reshape(len(sizes), horizon_days * k)
        got = settle(wishes, free.column("free").to_numpy())
        at = np.flatnonzero(got >= 0)
        chosen = pa.array(offsets[at] - offsets[0] + got[at] % k)
        own = mine.take(pa.array(at))
        return pa.table({**{c: own.column(c) for c in kinds}, "workshop_id": names.take(chosen), "day": pa.array(got[at] // k, pa.int32()), "distance_km": km.take(chosen)})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"workshop_id {shop}, day int, distance_km double"])
    for number in range(int(ranked.agg(F.max("block")).first()[0] or 0) + 1):
        own = ranked.filter(F.col("block") == number).drop("block", "one")
        found = cut(own.groupBy("tenant_id").cogroup(left.groupBy("tenant_id")).applyInArrow(settled, schema), "settled")
        given = found if given is None else given.unionByName(found)
        used = found.groupBy("tenant_id", "workshop_id", "day").agg(F.count("*").cast("int").alias("used"))
        left = cut(left.join(used, ["tenant_id", "workshop_id", "day"], "left").withColumn("free", F.col("free") - F.coalesce("used", F.lit(0))).filter("free > 0").drop("used"), "capacity")
        if left.isEmpty():
            break
    got = given.select("vehicle_id", "failure_mode", "workshop_id", "day", F.round("distance_km", 1).alias("distance_km"))
    out = cands.join(got, ["vehicle_id", "failure_mode"], "left")
    late = F.col("hours_remaining").isNotNull() & (F.col("day") * 24.0 > F.col("hours_remaining"))
    return out.withColumn("late", F.coalesce(late, F.lit(False)))


def plan_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("tenant_id").agg(F.count("workshop_id").alias("proposed"), F.count_if(F.col("late") & F.col("workshop_id").isNotNull()).alias("late"), F.count_if(F.col("workshop_id").isNull()).alias("unscheduled"), F.count_if(F.col("value_basis") == "cost").alias("by_cost"), F.count_if(F.col("value_basis") == "risk_only").alias("by_risk"))


def new_proposals(planned: DataFrame, orders: DataFrame, active: tuple[str, ...] = ("proposed", "scheduled", "in_progress")) -> DataFrame:
    """Planned rows that no active order holds yet, one for each vehicle and mode: a repeated run proposes nothing."""
    fresh = without_active_order(planned.filter("workshop_id IS NOT NULL"), orders, active)
    return fresh.groupBy("vehicle_id", "failure_mode").agg(F.max_by(F.struct(*fresh.columns), F.struct("value", "source_alert_id")).alias("r")).select("r.*")


def audit_rows(proposals: DataFrame, actor: str, at) -> DataFrame:
    return proposals.select(F.lit(actor).alias("actor"), F.lit("work_order.proposed").alias("action"), "tenant_id", F.to_json(F.struct("vehicle_id", "failure_mode", "workshop_id", "day", "value")).alias("details"), at.alias("at"))
