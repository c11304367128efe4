"""A latest-state view over entities, rollups of it, rankings, and merges of record sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.cleaning import lookup
from fieldlark.functions.geo import valid_fix
from fieldlark.operators.cleaning import keep_latest
from fieldlark.operators.records import location_kind

# Limits of staleness and levels, statuses of a model's classes, weights of the reasons for a visit.
STALE_DAYS, LEAST_INSPECTED, LEAST_COVERAGE = 45, 5, 0.2
CONCERN_SHARE, WATCH_SHARE = 0.3, 0.1
CLASS_STATUS = {"poor": "high-risk", "moderate": "moderate", "healthy": "healthy"}
PLAN_WEIGHTS = {"disease_hotspot": 100, "high_risk_stale": 80, "uncertain_hotspot": 60, "moderate_stale": 50, "never_inspected": 40, "weak_location": 15}


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest record of each entity; unknown times come last (A1)."""
    return keep_latest(df, [key], [F.desc_nulls_last(time), F.desc(tie)])


def latest_by_max(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """The same in one aggregate, without a sort; rows of unknown time are skipped (A2)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(time)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def twin_state(entities: DataFrame, key: str, facts: Mapping[str, DataFrame]) -> DataFrame:
    """Entities with the latest row of each fact table, prefixed with its name; outer joins keep all entities.

    All joins are on the entity's key, so one partitioning of each side serves them all.
    """
    out = entities
    for name, fact in facts.items():
        out = out.join(fact.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in fact.columns if c != key]), key, "left")
    return out


def plant_rows(plants: DataFrame, slots: DataFrame, inspections: DataFrame, sources: Sequence[str] = ("gps", "estimated", "smoothed")) -> DataFrame:
    """Living plants with their slot's position and their latest inspection, without a view or a model.

    ``plants`` is (plant_id, zone, block, slot_id, status, replaced_by), ``slots`` (slot_id, lat, lon, accuracy, source),
    ``inspections`` (plant_id, day, and what was seen). Positions out of the region and sources that are not known are null.
    """
    living = plants.where(F.col("plant_id").isNotNull() & ~F.col("status").eqNullSafe("retired") & F.col("replaced_by").isNull()).drop("status", "replaced_by")
    seen = [c for c in inspections.columns if c not in ("plant_id", "day")]
    last = latest_by_max(inspections.where("plant_id is not null and day is not null"), "plant_id", "day", ["day", *seen])
    inside = valid_fix(F.col("lat"), F.col("lon"))
    at = slots.select(
        "slot_id", F.when(inside, F.col("lat")).alias("lat"), F.when(inside, F.col("lon")).alias("lon"), F.round("accuracy", 1).alias("accuracy"),
        F.when(F.col("source").isin(*sources), F.col("source")).alias("source"),
    )
    out = living.join(at, "slot_id", "left").join(last, "plant_id", "left")
    return out.withColumn("block_id", F.concat(F.nullif(F.col("zone"), F.lit("")), F.lit("-"), F.nullif(F.col("block"), F.lit(""))))


def status(model_class: Column, foliage: Column, ph: Column, day: Column) -> Column:
    """A model's class if it is a known one; else not inspected without a date, and by foliage and acidity with one."""
    by_rule = (
        F.when(foliage == "Red", "dead")
        .when((foliage == "Brown") | (ph < 5.5) | (ph > 7), "high-risk")
        .when(foliage.isin("Yellow", "Mixed") | ((ph >= 5.5) & (ph < 6)) | ((ph > 6.5) & (ph <= 7)), "moderate")
        .otherwise("healthy")
    )
    return F.coalesce(lookup(F.lower(model_class), CLASS_STATUS), F.when(day.isNull(), "not-inspected").otherwise(by_rule))


def block_status(foliage: Column, ph: Column, day: Column) -> Column:
    """The variant of the block page: without an inspection a plant counts as healthy."""
    return F.when(day.isNull(), "healthy").otherwise(status(F.lit(None).cast("string"), foliage, ph, day))


def days_since(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def is_stale(day: Column, as_of: Column, most: int = STALE_DAYS) -> Column:
    """Inspected longer ago than allowed; without an inspection, not stale."""
    return F.coalesce(days_since(day, as_of) > most, F.lit(False))


def block_rollup(state: DataFrame, planted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by status, share at risk, coverage and level of each block, also of blocks without plants."""
    inspected = F.col("status") != "not-inspected"
    risk = F.col("status").isin("high-risk", "dead")
    own = state.groupBy(*keys).agg(
        F.count("*").alias("n_plants"), F.count_if(inspected).alias("n_inspected"), F.count_if(risk).alias("n_risk"), F.max("last_day").alias("last_day")
    )
    out = planted.join(own, list(keys), "full_outer").na.fill(0, ["n_plants", "n_inspected", "n_risk"])
    share = F.col("n_risk") / F.nullif(F.col("n_inspected"), F.lit(0))
    cover = F.col("n_inspected") / F.nullif(F.coalesce(F.col("planted"), F.col("n_plants")), F.lit(0))
    level = (
        F.when(F.col("n_inspected") == 0, "no-data")
        .when((F.col("n_inspected") < LEAST_INSPECTED) | (cover < LEAST_COVERAGE), "insufficient")
        .when(share >= CONCERN_SHARE, "concern")
        .when(share >= WATCH_SHARE, "watch")
        .otherwise("good")
    )
    return out.withColumns({"risk_share": share, "coverage": cover, "level": level})


def status_totals(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of plants of each status."""
    return state.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def data_trust(state: DataFrame, as_of: Column) -> DataFrame:
    """Coverage, stale share of the inspected, newest day, plants by where their position comes from: one row."""
    seen, stale = F.count("last_day"), F.count_if(is_stale(F.col("last_day"), as_of))
    kind = location_kind(F.col("latitude"), F.col("longitude"), F.col("location_source"))
    return state.agg(
        F.count("*").alias("total"),
        seen.alias("inspected"),
        (seen / F.nullif(F.count("*"), F.lit(0))).alias("coverage"),
        stale.alias("stale"),
        (stale / F.nullif(seen, F.lit(0))).alias("stale_share"),
        F.max("last_day").alias("newest"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("gps", "smoothed", "single_fix", "estimated", "none")],
    )


def field_plan(state: DataFrame, as_of: Column, weights: Mapping[str, int] = PLAN_WEIGHTS) -> DataFrame:
    """Plants to visit by the sum of their ``reasons``' weights; dead ones and those without a reason are left out.

    ``state`` has status, last_day, latitude, longitude, location_source and the likely_cause of the plant's hotspot.
    """
    stale, status_, cause = is_stale(F.col("last_day"), as_of), F.col("status"), F.col("likely_cause")
    unknown = F.col("latitude").isNull() | F.col("longitude").isNull()
    hits = {
        "disease_hotspot": cause == "likely_disease",
        "high_risk_stale": (status_ == "high-risk") & stale,
        "uncertain_hotspot": cause == "uncertain_expert_review",
        "moderate_stale": (status_ == "moderate") & stale,
        "never_inspected": status_ == "not-inspected",
        "weak_location": unknown | F.coalesce(F.col("location_source").isin("estimated", "single_fix"), F.lit(False)),
    }
    total = sum((F.when(c, weights[k]).otherwise(0) for k, c in hits.items()), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in hits.items()]))
    out = state.where("status != 'dead'").withColumns({"priority": total, "reasons": reasons, "days": days_since(F.col("last_day"), as_of)})
    return out.where("priority > 0")


def top_of_plan(plan: DataFrame, key: str, k: int) -> DataFrame:
    """The k most urgent; never visited before long ago, then by key."""
    return plan.orderBy(F.desc("priority"), F.desc_nulls_first("days"), F.asc(key)).limit(k)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any column holds the text, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(hit)


def map_filter(state: DataFrame, zone: object = None, statuses: Sequence[str] | None = None, stale: bool | None = None, as_of: Column | None = None, text: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Optional conditions, all of which must hold."""
    if zone is not None:
        state = state.where(F.col("zone") == zone)
    if statuses is not None:
        state = state.where(F.col("status").isin(*statuses))
    if stale is not None:
        state = state.where(is_stale(F.col("last_day"), as_of) == stale)
    return search(state, text, columns) if text else state


def incremental(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have not been scored yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the first, and those of the second with other keys."""
    rest = second.join(first.select(*keys).distinct(), list(keys), "left_anti")
    return first.unionByName(rest, allowMissingColumns=True)


def merged(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Records of either side; a known local field wins over the remote one."""
    fields = [c for c in dict.fromkeys([*local.columns, *remote.columns]) if c != key]
    a = local.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in local.columns if c != key])
    b = remote.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in remote.columns if c != key])
    of = lambda c: [F.col(f"{p}_{c}") for p, df in (("a", local), ("b", remote)) if c in df.columns]
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(*of(c)).alias(c) for c in fields])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each key; at a tie the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, [F.desc_nulls_last(version), F.desc("_new")]).drop("_new")


def last_writer(local: DataFrame, remote: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """The remote value only if it is strictly newer (R2)."""
    both = local.select(key, value, time, F.lit(1).alias("_own")).unionByName(remote.select(key, value, time, F.lit(0).alias("_own")))
    return keep_latest(both, [key], [F.desc_nulls_last(time), F.desc("_own")]).drop("_own")


def pull(local: DataFrame, remote: DataFrame, key: str, pending: Column) -> DataFrame:
    """Remote rows replace local ones, but never a local row that is still to be sent."""
    kept = local.where(pending)
    return kept.unionByName(remote.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def with_parents(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and the others."""
    own = parents.select(key).distinct()
    return rows.join(own, key, "left_semi"), rows.join(own, key, "left_anti")


def replaced(plants: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retired plants, their successors of the next generation, and the slots' new plants.

    ``plants`` has plant_id, slot_id, generation; ``replacements`` plant_id and day.
    """
    old = plants.join(replacements, "plant_id")
    after = F.concat(F.regexp_replace("plant_id", r"-G\d+$", ""), F.lit("-G"), (F.col("generation") + 1).cast("string"))
    retired = old.select("plant_id", F.lit("retired").alias("status"), F.col("day").alias("retired_date"), after.alias("replaced_by"))
    born = old.select(after.alias("plant_id"), "slot_id", (F.col("generation") + 1).alias("generation"), F.col("plant_id").alias("previous_plant_id"))
    return retired, born, born.select("slot_id", F.col("plant_id").alias("active_plant_id"))


def expected_slots(layout: Mapping[str, tuple[int, int]], df: DataFrame) -> DataFrame:
    """(block, slot) of a layout of zones with blocks and plants in a block, such as {'A': (5, 5)}."""
    spark = df.sparkSession
    rows = [(z, b, p) for z, (b, p) in layout.items()]
    grid = spark.createDataFrame(rows, "zone string, blocks int, plants int").withColumn("b", F.explode(F.sequence(F.lit(1), "blocks"))).withColumn("p", F.explode(F.sequence(F.lit(1), "plants")))
    block = F.concat("zone", F.lpad(F.col("b").cast("string"), 2, "0"))
    return grid.select(block.alias("block"), F.concat(block, F.lit("-P"), F.lpad(F.col("p").cast("string"), 3, "0")).alias("slot_id"))


def coverage_check(expected: DataFrame, found: DataFrame, key: str = "slot_id") -> DataFrame:
    """(state, n): slots that are present, missing, unexpected, and those found more than once."""
    n = found.groupBy(key).agg(F.count("*").alias("n_found"))
    both = expected.select(key, F.lit(1).alias("n_expected")).join(n, key, "full_outer").na.fill(0, ["n_expected", "n_found"])
    states = F.array_compact(
        F.array(
            F.when((F.col("n_expected") > 0) & (F.col("n_found") > 0), F.lit("present")),
            F.when((F.col("n_expected") > 0) & (F.col("n_found") == 0), F.lit("missing")),
            F.when((F.col("n_expected") == 0) & (F.col("n_found") > 0), F.lit("unexpected")),
            F.when(F.col("n_found") > 1, F.lit("duplicate")),
        )
    )
    return both.select(F.explode(states).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest_areas(trends: DataFrame) -> DataFrame:
    """The newest trend of each area."""
    return keep_latest(trends, ["level", "entity_id"], [F.desc_nulls_last("window_end"), F.desc_nulls_last("created_at")])


def members_decoded(plants: DataFrame, hotspots: DataFrame, key: str = "plant_id") -> DataFrame:
    """Plants with the last hotspot that lists them."""
    each = hotspots.select(*[c for c in hotspots.columns if c != "member_plant_ids"], F.explode("member_plant_ids").alias(key))
    return plants.join(keep_latest(each, [key], [F.desc("cycle"), F.desc("hotspot_id")]), key, "left")
