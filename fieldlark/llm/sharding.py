"""Balanced label propagation: documents to shards of even size.

Documents with equal texts are linked. A group of linked documents is a hub, and
each document an edge to it, so a group of n has n edges and not n squared. In each
round a hub's most frequent shard is found by an aggregate, its members elsewhere
ask to move there, and requests are admitted under quotas: as many as go the other
way between two shards, and more into shards with room left (Ugander and Backstrom
2013). The rounds end when no fewer documents ask to move than in the round before. Then the linked documents that a shard has over its share, and
all documents without links, fill the shards to sizes at most one row apart.

Only counts for pairs of shards come to the driver. Rows are numbered by counts of
buckets of bounded size and a running number inside a bucket; a hub that is large
is spread over several buckets. Rows are dealt by a number of their own, so equal rows are no
bucket.

Edge cases. A null text has size 1, no link, and the checksum of an empty text.
Empty texts are a group like any other. Repeated rows are separate rows of one
group. A null doc_id is allowed. Fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import cut

_UNIT = 1 << 20


@dataclass(frozen=True)
class Sharding:
    shards: int = 16
    rounds: int = 20
    bucket_rows: int = 20_000
    seed: int = 5


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each flow (from, to) that is admitted: swaps, and then what the target has room for."""
    got = {(i, j): min(n, asked.get((j, i), 0)) for (i, j), n in asked.items()}
    room = list(room)
    for (i, j), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - got[i, j], max(0, room[j]))
        got[i, j] += more
        room[j] -= more
        room[i] += more
    return {k: got[k] / n for k, n in asked.items()}


def _by_pair(share: dict[tuple[int, int], float], k: int, a: Column, b: Column) -> Column:
    """Looks up a share of ``_UNIT`` by two shard numbers."""
    flat = [int(share.get((i, j), 0.0) * _UNIT) for i in range(k) for j in range(k)]
    return F.element_at(F.array(*map(F.lit, flat)), (a * k + b + 1).cast("int"))


def _propagated(nodes: DataFrame, o: Sharding, target: list[int]) -> DataFrame:
    """``home`` of the linked rows after a few rounds of moves."""
    hub, before = ["h1", "h2"], float("inf")
    for _ in range(o.rounds):
        count = nodes.groupBy(*hub, "home").agg(F.count("*").alias("n"))
        best = count.groupBy(*hub).agg(F.max_by("home", F.struct("n", F.xxhash64("h1", "h2", "home"))).alias("best"))
        asked = nodes.join(best, hub)
        flow = {(r["home"], r["best"]): r["n"] for r in asked.groupBy("home", "best").agg(F.count("*").alias("n")).collect()}
        load = [sum(n for (i, _), n in flow.items() if i == k) for k in range(o.shards)]
        flow = {k: n for k, n in flow.items() if k[0] != k[1]}
        if not flow:
            break
        # Where no fewer ask to move than before, what is left does not fit.
        if sum(flow.values()) >= before:
            break
        before = sum(flow.values())
        share = quotas(flow, [t - n for t, n in zip(target, load, strict=True)])
        # A group moves in parts of a 64th of a shard at most.
        parts = F.ceil(F.col("members") * 64 / max(1, *target))
        draw = F.xxhash64("h1", "h2", F.pmod(F.xxhash64("number", "h1"), parts))
        moves = (F.col("home") != F.col("best")) & (F.pmod(draw, F.lit(_UNIT)) < _by_pair(share, o.shards, F.col("home"), F.col("best")))
        nodes = cut(asked.withColumn("home", F.when(moves, F.col("best")).otherwise(F.col("home"))).drop("best"))
    return nodes


def _numbered(rows: DataFrame, o: Sharding, n: int) -> DataFrame:
    """``rank`` of each row from 0 within (home, linked), groups together: bucket counts, then numbers inside buckets."""
    key = ["home", "linked", "bucket", "part"]
    buckets = max(1, n // (o.bucket_rows * o.shards))
    rows = rows.withColumns(
        {
            "bucket": F.pmod(F.when(F.col("linked"), F.xxhash64("h1", "h2")).otherwise(F.xxhash64("number")), F.lit(buckets)),
            "part": F.pmod(F.xxhash64("number", "h2"), F.when(F.col("linked"), F.ceil(F.col("members") / o.bucket_rows)).otherwise(F.lit(1))),
        }
    )
    before = Window.partitionBy("home", "linked").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    count = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*key).orderBy("h1", "h2", "doc_id", "size", "number")
    return rows.withColumn("_at", F.row_number().over(inside) - 1).join(count, key).withColumn("rank", F.col("_at") + F.col("first")).drop("_at", "first", "bucket", "part")


def _step(x: Column, ends: list[int]) -> Column:
    """How many of the ends ``x`` has reached."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in ends), F.lit(0))


def shards(docs: DataFrame, o: Sharding | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, crc, shard, slot: one row for each row of ``docs``; shards' row counts are at most one apart."""
    o = o or Sharding()
    body = F.col(text).cast("string")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
        F.when(body.isNotNull(), F.xxhash64(body)).alias("h1"),
        F.when(body.isNotNull(), F.xxhash64(F.lit(o.seed), body)).alias("h2"),
        F.monotonically_increasing_id().alias("number"),
    )
    base = cut(base)
    hubs = base.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("members")).where("members > 1")
    nodes = base.join(hubs, ["h1", "h2"], "left")
    nodes = nodes.withColumn("linked", F.col("members").isNotNull())
    nodes = nodes.withColumn("home", F.pmod(F.xxhash64("number", F.lit(o.seed)), F.lit(o.shards)).cast("int"))
    nodes = cut(nodes)
    n = nodes.count()
    target = [n // o.shards + (k < n % o.shards) for k in range(o.shards)]
    linked = _propagated(nodes.where("linked"), o, target)
    rows = _numbered(linked.select(*nodes.columns).unionAll(nodes.where("not linked")), o, n)
    rows = cut(rows)
    count = {(r["home"], r["linked"]): r["n"] for r in rows.groupBy("home", "linked").agg(F.count("*").alias("n")).collect()}
    # Stay: linked rows within the share. Pool: linked rows over it, home by home, then all others.
    stay = [min(count.get((k, True), 0), target[k]) for k in range(o.shards)]
    over = [count.get((k, True), 0) - stay[k] for k in range(o.shards)]
    free = [count.get((k, False), 0) for k in range(o.shards)]
    first_over = [sum(over[:k]) for k in range(o.shards)]
    first_free = [sum(over) + sum(free[:k]) for k in range(o.shards)]
    need = [t - s for t, s in zip(target, stay, strict=True)]
    ends = [sum(need[: k + 1]) for k in range(o.shards)]
    of = lambda values, k: F.element_at(F.array(*[F.lit(int(v)) for v in values]), (k + 1).cast("int"))
    home, rank = F.col("home"), F.col("rank")
    rows = rows.withColumn("pool", F.when(~F.col("linked"), of(first_free, home) + rank).when(rank >= of(stay, home), of(first_over, home) + rank - of(stay, home)))
    rows = rows.withColumn("shard", F.when(F.col("pool").isNull(), home).otherwise(_step(F.col("pool"), ends)).cast("int"))
    slot = F.when(F.col("pool").isNull(), rank).otherwise(F.col("pool") - of([0, *ends[:-1]], F.col("shard")) + of(stay, F.col("shard")))
    return rows.select("doc_id", "size", "crc", "shard", slot.cast("long").alias("slot"), "h1", "h2")


def cut_edges(sharded: DataFrame) -> DataFrame:
    """members, cut: of the linked documents, how many are outside their group's most frequent shard."""
    each = sharded.where("h1 is not null").groupBy("h1", "h2", "shard").agg(F.count("*").alias("n"))
    hub = each.groupBy("h1", "h2").agg(F.sum("n").alias("members"), F.max("n").alias("most")).where("members > 1")
    return hub.agg(F.sum("members").alias("members"), F.sum(F.col("members") - F.col("most")).alias("cut"))
