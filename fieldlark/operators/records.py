"""Record sets of a field application: lookups with fallbacks, histories, checks of consistency, logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.cleaning import keep_latest


def first_known(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def located(records: DataFrame, plants: DataFrame, key: str = "plant_id") -> DataFrame:
    """slot_id, zone and block of records: their own, else the plant's, else from the plant's id."""
    names = ("slot_id", "zone", "block")
    p = plants.select(key, *[F.col(c).alias(f"_p_{c}") for c in names])
    patterns = {"slot_id": r"^([A-D]\d{2}-P\d{3})-G\d+$", "zone": r"^([A-D])\d{2}-", "block": r"^([A-D]\d{2})-"}
    own = {c: F.col(c) if c in records.columns else F.lit(None).cast("string") for c in names}
    return records.join(p, key, "left").withColumns({c: first_known(own[c], F.col(f"_p_{c}"), F.regexp_extract(key, patterns[c], 1)) for c in names}).drop(*[f"_p_{c}" for c in names])


def location_kind(lat: Column, lon: Column, source: Column) -> Column:
    """Where a position comes from, or none."""
    return F.when(lat.isNull() | lon.isNull(), "none").otherwise(F.coalesce(source, F.lit("gps")))


def summed_reports(local: DataFrame, remote: DataFrame, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """Sums over reports that are merged by id, the newest version of each (A10)."""
    both = local.unionByName(remote, allowMissingColumns=True)
    return keep_latest(both, [key], [F.desc_nulls_last(version)]).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])


def id_issues(df: DataFrame, key: str, parts: Mapping[str, str]) -> DataFrame:
    """(key, issues): columns that disagree with what the id says."""
    wrong = [F.when(~F.col(c).eqNullSafe(F.regexp_extract(key, p, 1)), F.lit(c)) for c, p in parts.items()]
    return df.select(key, F.concat_ws(",", *wrong).alias("issues")).where("issues != ''")


def hotspot_shapes(rows: DataFrame) -> DataFrame:
    """(cluster_id, members, n, radius_m) of the newest cycle of rows (cycle, cluster_id, plant_id, area_m2, created_at)."""
    newest = rows.agg(F.max("cycle").alias("_newest"))
    own = rows.crossJoin(F.broadcast(newest)).where("cycle = _newest and cluster_id > 0")
    area = F.coalesce(F.max_by("area_m2", "created_at"), F.lit(400.0))
    out = own.groupBy("cluster_id").agg(F.sort_array(F.collect_set("plant_id")).alias("members"), F.greatest(F.sqrt(area / F.pi()), F.lit(22.0)).alias("radius_m"))
    return out.withColumn("n", F.size("members"))


def track_measures(tracks: DataFrame) -> DataFrame:
    """persistence, first_size and added_total of each track so far."""
    w = Window.partitionBy("hotspot_id").orderBy("cycle")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return tracks.withColumns({"persistence": F.count("*").over(run), "first_size": F.first("size").over(w), "added_total": F.sum("added").over(run)})


def to_check(hotspots: DataFrame) -> DataFrame:
    """Referred hotspots first, then by size (T4)."""
    return hotspots.orderBy(F.desc("referred"), F.desc("size"), F.asc("hotspot_id"))


def upper_median(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The value at place n // 2 from 0 in order (F14): no mean of two values."""
    w = Window.partitionBy(*keys)
    n = df.where(F.col(column).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(column)) - 1)
    return n.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*keys, F.col(column).alias("upper_median"))


def tracked(df: DataFrame, key: str, total: str, count: int) -> DataFrame:
    """(key, number): plants numbered 1 + i * step with step total // count."""
    step = F.greatest(F.lit(1), F.floor(F.col(total) / count)).cast("long")
    return df.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(count), F.col(total).cast("int")) - 1), lambda i: 1 + i * step)).alias("number"))


def previous_height(inspections: DataFrame, legacy: DataFrame, key: str, day: str, height: str) -> DataFrame:
    """Height of the newest inspection, else of the newest legacy record; zero is unknown."""
    of = lambda df, name: df.groupBy(key).agg(F.max_by(height, day).alias(name))
    both = of(inspections, "_a").join(of(legacy, "_b"), key, "full_outer")
    return both.select(key, F.nullif(F.coalesce("_a", "_b"), F.lit(0)).alias("previous"))


def store_counts(stores: Mapping[str, DataFrame], pending: Column) -> DataFrame:
    """(store, n, pending) of each record store."""
    out = None
    for name, df in stores.items():
        one = df.agg(F.count("*").alias("n"), F.count_if(pending).alias("pending")).select(F.lit(name).alias("store"), "n", "pending")
        out = one if out is None else out.unionAll(one)
    return out


def marked_synced(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Status and address of records that have been sent (E9). ``done`` is (key, url)."""
    both = records.join(done.select(key, F.col("url").alias("_url"), F.lit(True).alias("_done")), key, "left")
    return both.withColumns({"status": F.when(F.col("_done"), "synced").otherwise(F.col("status")), "url": F.coalesce("_url", "url")}).drop("_url", "_done")


def coordinates(plants: DataFrame, slots: DataFrame, legacy: DataFrame) -> DataFrame:
    """plant_id, lat, lon: of the slot, else of the legacy store."""
    s = slots.select("slot_id", F.col("latitude").alias("_a"), F.col("longitude").alias("_b"))
    old = legacy.select("plant_id", F.col("lat").alias("_c"), F.col("lon").alias("_d"))
    return plants.join(s, "slot_id", "left").join(old, "plant_id", "left").select("plant_id", F.coalesce("_a", "_c").alias("lat"), F.coalesce("_b", "_d").alias("lon"))


def class_counts(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """(class, n) of all classes, zero where there is none."""
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(n, column, "left").na.fill(0, ["n"])


def recomputed(stored: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """Rows where a stored and a recomputed value are not the same, or one is missing."""
    both = stored.select(*keys, F.col(value).alias("stored")).join(new.select(*keys, F.col(value).alias("new")), list(keys), "full_outer")
    return both.where(F.coalesce(F.abs(F.col("stored") - F.col("new")) > tolerance, F.lit(True)))


def retrieval_log(nearest: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, nearest): the k nearest as an array, distances to a centimetre."""
    return nearest.where(F.col("rank") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "b", F.round("distance", 2).alias("distance")))).alias("nearest"))


def with_legacy_session(observations: DataFrame, originals: DataFrame) -> DataFrame:
    """Observations with each slot's first fix as a session of its own, once."""
    old = originals.select(F.concat(F.lit("legacy-"), F.col("slot_id")).alias("session_id"), *[c for c in observations.columns if c != "session_id"])
    return observations.unionByName(old.join(observations.select("session_id").distinct(), "session_id", "left_anti"))


def carry_over_expired(updated: Column, as_of: Column, most: int = 30) -> Column:
    """Whether a choice carried over is older than so many days, a day begun counting in full."""
    return F.coalesce(F.ceil((F.unix_timestamp(as_of) - F.unix_timestamp(updated)) / 86_400) > most, F.lit(False))


def crop_windows(images: DataFrame, key: str, size: str, window: int, overlap: int) -> DataFrame:
    """(key, start, end) of overlapping windows; the last one ends at the image's end."""
    step = window - overlap
    count = F.greatest(F.lit(1), F.ceil((F.col(size) - overlap) / step)).cast("int")
    each = images.select(key, size, F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    start = F.greatest(F.lit(0), F.least(F.col("i") * step, F.col(size) - window)).cast("int")
    return each.select(key, start.alias("start"), F.least(start + window, F.col(size)).cast("int").alias("end"))


def deranged(df: DataFrame, key: str, group: str, seed: int = 0) -> DataFrame:
    """(key, other): a partner of another group for each row.

    Rows are put in an order in which groups follow each other, and each takes the row half the way
    round; a group of over half of all rows cannot be paired in full and its rest gets null.
    Numbers come from counts of groups and places inside them, so no task holds all rows.
    """
    n = df.groupBy(group).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("_c"), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_first", before).crossJoin(F.broadcast(n.agg(F.sum("_c").alias("_n"))))
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1
    rows = df.withColumn("_i", at).join(n, group).select(key, group, (F.col("_first") + F.col("_i")).alias("_at"), "_n")
    partner = rows.select(F.col("_at"), F.col(key).alias("other"), F.col(group).alias("_g"))
    want = rows.withColumn("_at", F.pmod(F.col("_at") + F.ceil(F.col("_n") / 2), F.col("_n")))
    return want.join(partner, "_at", "left").select(key, F.when(F.col(group) != F.col("_g"), F.col("other")).alias("other"))


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(common, only_a, only_b) distinct keys."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def defect_scores(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(defect, precision, recall) of detected defects against injected ones, both (keys, defect)."""
    both = found.select(*keys, "defect", F.lit(1).alias("_f")).distinct().join(truth.select(*keys, "defect", F.lit(1).alias("_t")).distinct(), [*keys, "defect"], "full_outer")
    hit = F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull())
    return both.groupBy("defect").agg((hit / F.greatest(F.count("_f"), F.lit(1))).alias("precision"), (hit / F.greatest(F.count("_t"), F.lit(1))).alias("recall"))


def imputation_error(filled: DataFrame, truth: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(n, mae) of values that were missing and have been filled (M22). ``filled`` has ``<column>_imputed``."""
    both = filled.where(F.col(f"{column}_imputed")).select(*keys, column).join(truth.select(*keys, F.col(column).alias("_t")), list(keys)).where(F.col("_t").isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(column) - F.col("_t"))).alias("mae"))


def field_accuracy(read: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, correct, blank, wrong) of readings ``<field>`` against ``<field>_true``."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), F.col(f"{f}_true").cast("string").alias("t")) for f in fields]
    each = read.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return each.groupBy("field").agg(F.count_if(F.col("v") == F.col("t")).alias("correct"), F.count_if(F.col("v").isNull()).alias("blank"), F.count_if(F.col("v") != F.col("t")).alias("wrong"))


def study_window(df: DataFrame, day: str, start: str, end: str, days_after: int = 1) -> DataFrame:
    """(start, end) of a study: fixed days, the end put off to the day after the newest record if that is later."""
    newest = F.date_add(F.max(F.to_date(day)), days_after)
    return df.agg(F.lit(start).cast("date").alias("start"), F.greatest(F.lit(end).cast("date"), newest).alias("end"))


def fixes_of_plants(fixes: DataFrame, plants: DataFrame, slot: str = "slot_id") -> DataFrame:
    """Fixes with the plant that stands on their slot; fixes without one are left out."""
    return fixes.join(plants.select(slot, "plant_id"), slot)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def sample_rows(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The first k rows by key, for a look at a table."""
    return df.orderBy(key).limit(k)


def checked_join(features: DataFrame, labels: DataFrame, metadata: DataFrame, key: str, label: str, classes: int) -> DataFrame:
    """Features with their label and metadata (J17); an error unless each feature row has one partner on either side and all classes occur.

    The counts come from one aggregate over keys before the join that gives the rows.
    """
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = n(features, "_f").join(n(labels, "_l"), key, "left").join(n(metadata, "_m"), key, "left")
    odd = both.where("_f != 1 or coalesce(_l, 0) != 1 or coalesce(_m, 0) != 1").agg(F.count("*").alias("odd"))
    seen = labels.join(features.select(key), key, "left_semi").agg(F.count_distinct(label).alias("seen"))
    check = odd.crossJoin(seen)
    ok = F.when((F.col("odd") == 0) & (F.col("seen") == classes), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("rows without one partner: "), F.col("odd").cast("string"), F.lit(", classes: "), F.col("seen").cast("string")))
    )
    out = features.join(labels, key).join(metadata, key)
    return out.crossJoin(F.broadcast(check.select(ok.alias("_ok")))).where("_ok").drop("_ok")


def first_complete(sources: Sequence[DataFrame], least: int = 1) -> DataFrame:
    """The first source that can be read and has enough rows, such as a server's, a snapshot's, a base table's."""
    from pyspark.errors import PySparkException

    for df in sources[:-1]:
        try:
            if df.limit(least).count() >= least:
                return df
        except PySparkException:
            continue
    return sources[-1]
