"""Passages, ranking and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.text import dot, windows


def chunks(docs: DataFrame, key: str, text: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """(key, chunk, start, n_words, text) of overlapping word windows (V4, V5)."""
    each = docs.select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk", "w"))
    return each.select(key, "chunk", F.col("w.start").alias("start"), F.size("w.words").alias("n_words"), F.array_join("w.words", " ").alias("text"))


def outline(lines: Column) -> Column:
    """The headings among an array of lines, (line, level, number, title), as a fold whose state is the place in the outline (V2).

    A line names a place by one to three numbers of up to two digits with points between, maybe one behind, and a title that
    begins with a capital and has 3 to 71 characters. It counts if the place is the next one on the top level, or lies
    directly below the place that is open on the level above; so a numbered list in a body is no heading.
    """
    parsed = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([0-9.]+)\s", 1).alias("label"), F.trim(F.regexp_extract(s, r"^[0-9.]+\s+(.*)$", 1)).alias("title")))
    name = lambda p: F.regexp_replace(p["label"], r"\.$", "")
    fits = lambda p: name(p).rlike(r"^[0-9]{1,2}(\.[0-9]{1,2}){0,2}$") & p["title"].rlike(r"^[A-Z]") & F.length(p["title"]).between(3, 71)
    path = lambda p: F.transform(F.split(name(p), r"\."), lambda x: x.try_cast("int"))
    place = F.transform(parsed, lambda p, i: F.struct(i.alias("line"), F.when(fits(p), path(p)).alias("path"), name(p).alias("number"), p["title"].alias("title")))

    def step(s: Column, p: Column) -> Column:
        depth = F.size(p["path"])
        open_ = s["open"]
        next_top = (depth == 1) & (p["path"][0] == F.get(open_, F.lit(0)) + 1)
        below = (depth > 1) & (F.size(open_) >= depth - 1) & (F.slice(open_, 1, F.greatest(depth - 1, F.lit(1))) == F.slice(p["path"], 1, F.greatest(depth - 1, F.lit(1))))
        taken = p["path"].isNotNull() & (next_top | below)
        # A place of the third level leaves the second open.
        opened = F.when(depth < 3, p["path"]).otherwise(open_)
        heading = F.struct(p["line"].alias("line"), depth.alias("level"), p["number"].alias("number"), p["title"].alias("title"))
        return F.when(F.coalesce(taken, F.lit(False)), F.struct(opened.alias("open"), F.concat(s["found"], F.array(heading)).alias("found"))).otherwise(s)

    # Before the first part the place is 0, below which parts of a preface may be numbered.
    start = F.struct(F.array(F.lit(0)).alias("open"), F.array().cast("array<struct<line:int,level:int,number:string,title:string>>").alias("found"))
    return F.aggregate(place, start, step)["found"]


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, title, body) of the numbered sections of an outline (V2); what stands before the first is left out."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.trim(s))
    each = docs.select(key, lines.alias("_lines")).withColumn("_found", outline(F.col("_lines"))).select(key, "_lines", "_found", F.posexplode("_found").alias("_i", "_h"))
    end = F.coalesce(F.get("_found", F.col("_i") + 1)["line"], F.size("_lines"))
    body = F.slice("_lines", F.col("_h.line") + 2, end - F.col("_h.line") - 1)
    return each.select(key, F.col("_h.number").alias("number"), F.col("_h.title").alias("title"), F.array_join(F.filter(body, lambda s: s != ""), " ").alias("body"))


def top_k(queries: DataFrame, items: DataFrame, k: int, query_block: int = 4_096, item_block: int = 65_536, apart: str | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k largest inner products of each query (J16, T1, V1), ties by item id.

    ``queries`` and ``items`` are (id, vector); vectors must not be null. Both are dealt into blocks, and a cell of the
    grid of blocks holds one block of queries and lets its items pass by in batches, keeping k for each query. The k best
    of the cells' are ranked by Spark, which keeps k of a query in each task before it shuffles. So neither the
    driver nor a task holds more than a block. Items with the query's own value of the column ``apart`` are left out.
    """
    extra = [F.col(apart).cast("string").alias("apart")] if apart else [F.lit(None).cast("string").alias("apart")]
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries, n_items = queries.count(), items.count()
    across, down = max(1, -(-n_queries // query_block)), max(1, -(-n_items // item_block), min(parts, n_items // 256))

    def dealt(df: DataFrame, kind: int, own: str, blocks: int, other: str, others: int) -> DataFrame:
        rows = df.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), *extra, F.lit(kind).alias("kind"))
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    grid = dealt(queries, 0, "qb", across, "ib", down).unionByName(dealt(items, 1, "ib", down, "qb", across))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        ready = None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("qb", "ib", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cell != (now := tuple(names[a, :2])):
                    cell, held, ready = now, [], None
                if names[a, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = (np.concatenate([h.column("id").to_numpy() for h in held]), np.concatenate([_rows(h.column("vector")) for h in held]), [x for h in held for x in h.column("apart").to_pylist()])
                ids, q, groups = ready
                own = part.column("id").to_numpy()
                order = np.argsort(own, kind="stable")
                s = q @ _rows(part.column("vector"))[order].T
                if apart:
                    names_ = {x: i for i, x in enumerate(dict.fromkeys([*groups, *part.column("apart").to_pylist()]))}
                    mine, theirs = (np.array([names_[x] if x is not None else -1 - i for x in y]) for i, y in enumerate((groups, part.column("apart").to_pylist())))
                    s[mine[:, None] == theirs[order][None, :]] = -np.inf
                # Ties are by id, so scores that are equal in nine digits must not decide who is kept.
                top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(s, top, 1)
                keep = got.ravel() > -np.inf
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, top.shape[1])[keep], "item_id": own[order][top].ravel()[keep], "score": got.ravel()[keep]})

    cells = grid.repartition(max(parts, min(across * down, 8 * parts)), "qb", "ib").sortWithinPartitions("qb", "ib", "kind")
    found = cells.mapInArrow(best, "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def rank_shift(ranked: DataFrame, first: int, last: int) -> DataFrame:
    """Later ranks in place of the first."""
    return ranked.where(F.col("rank").between(first, last)).withColumn("rank", F.col("rank") - first + 1)


def without_gold(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The k best items after the relevant ones are taken away, ranked anew."""
    rest = ranked.join(gold, ["query_id", "item_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return rest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, n_relevant, recall, hit1, hitk, mrr) for queries with at least one relevant item."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "item_id"])
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hit"), F.min("rank").alias("first"))
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    out = n.join(found, "query_id", "left")
    return out.select(
        "query_id", "n_relevant", (F.coalesce("n_hit", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit1"), F.col("first").isNotNull().cast("int").alias("hitk"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def recall_grid(trials: DataFrame, radii: Sequence[float], ks: Sequence[int]) -> DataFrame:
    """(radius, k, recall) over logged trials (distance and rank of the true answer)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(k).alias("k")) for r in radii for k in ks]))
    hit = (F.col("distance") <= F.col("g.radius")) & (F.col("rank") <= F.col("g.k"))
    each = trials.withColumn("g", grid)
    return each.groupBy(F.col("g.radius").alias("radius"), F.col("g.k").alias("k")).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("recall"))


def score_gaps(ranked: DataFrame) -> DataFrame:
    """(query_id, top, gap12, gap23, spread) of the three best scores (V8)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    w = ranked.where("rank <= 3").groupBy("query_id")
    return w.agg(at(1).alias("top"), (at(1) - at(2)).alias("gap12"), (at(2) - at(3)).alias("gap23"), F.stddev_pop("score").alias("spread"))


def token_matches(query_tokens: DataFrame, passage_tokens: DataFrame) -> DataFrame:
    """(query_id, token, rank, m): the best match of each query token in each of the query's passages."""
    both = query_tokens.withColumnRenamed("vector", "q").join(passage_tokens.withColumnRenamed("vector", "p"), "query_id")
    return both.groupBy("query_id", "token", "rank").agg(F.max(dot(F.col("q"), F.col("p"))).alias("m"))


def late_interaction(query_tokens: DataFrame, passage_tokens: DataFrame) -> DataFrame:
    """Best match of each query token over the tokens of its passages (V6).

    mean_max, min_max and p25_max are over all passages, ``single`` is the mean of the best single passage, ``rank1``
    that of the first, ``delta`` what all together have over the best one. ``query_tokens`` is (query_id, token,
    vector), ``passage_tokens`` (query_id, rank, vector) of the passages retrieved for the query, a few hundred tokens each.
    """
    each = token_matches(query_tokens, passage_tokens)
    means = each.groupBy("query_id", "rank").agg(F.avg("m").alias("mean"))
    means = means.groupBy("query_id").agg(F.max("mean").alias("single"), F.max(F.when(F.col("rank") == 1, F.col("mean"))).alias("rank1"))
    best = each.groupBy("query_id", "token").agg(F.max("m").alias("m"))
    best = best.groupBy("query_id").agg(F.avg("m").alias("mean_max"), F.min("m").alias("min_max"), F.percentile("m", F.lit(0.25)).alias("p25_max"))
    return best.join(means, "query_id").withColumn("delta", F.col("mean_max") - F.col("single"))


def sparse_weighted(matches: DataFrame) -> DataFrame:
    """(query_id, weighted, hard): mean of the matches by weight, or plain where all weights are zero, and the least
    match of the tokens whose weight is at least the median (V7). ``matches`` is (query_id, weight, m)."""
    w = Window.partitionBy("query_id")
    df = matches.withColumn("_mid", F.median("weight").over(w))
    total = F.sum("weight")
    return df.groupBy("query_id").agg(
        F.when(total > 0, F.sum(F.col("weight") * F.col("m")) / total).otherwise(F.avg("m")).alias("weighted"), F.min(F.when(F.col("weight") >= F.col("_mid"), F.col("m"))).alias("hard")
    )


def section_features(passages: DataFrame) -> DataFrame:
    """(query_id, n_sections, same_section, n_words) of the retrieved passages (V9)."""
    return passages.groupBy("query_id").agg(
        F.count_distinct("section").alias("n_sections"), (F.count_distinct("section") == 1).alias("same_section"), F.sum("n_words").alias("n_words")
    )


def passage_features(top: DataFrame, query_tokens: DataFrame, passage_tokens: DataFrame, passages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each query with the features of three passages, whichever they are.

    ``top`` is (query_id, item_id, rank, score); a score of ``stored`` (query_id, item_id, score) stands in place of the
    computed one. ``query_tokens`` is (query_id, token, weight, vector), ``passage_tokens`` (item_id, vector), ``passages``
    (item_id, section, n_words). Queries without tokens have matches of 0.
    """
    if stored is not None:
        top = top.join(stored.withColumnRenamed("score", "_s"), ["query_id", "item_id"], "left").withColumn("score", F.coalesce("_s", "score")).drop("_s")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    out = top.join(passages, "item_id").groupBy("query_id").agg(
        *[at("score", r).alias(f"s{r}") for r in (1, 2, 3)], F.avg("score").alias("s_mean"), F.stddev_pop("score").alias("s_std"), F.count_distinct("section").alias("n_sections"),
        (at("section", 1) == at("section", 2)).cast("int").alias("same_section_12"), *[at("n_words", r).alias(f"words{r}") for r in (1, 2, 3)], F.sum("n_words").alias("n_words"),
    )
    out = out.withColumns({f"gap{a}{b}": F.col(f"s{a}") - F.col(f"s{b}") for a, b in ((1, 2), (1, 3), (2, 3))})
    of_top = top.select("query_id", "rank", "item_id").join(passage_tokens, "item_id").drop("item_id")
    tokens = query_tokens.select("query_id", "token", "vector")
    best = token_matches(tokens, of_top).groupBy("query_id", "token").agg(F.max("m").alias("m"))
    weighted = sparse_weighted(best.join(query_tokens.select("query_id", "token", "weight"), ["query_id", "token"]))
    n = query_tokens.groupBy("query_id").agg(F.count("*").alias("n_tokens"))
    for part in (late_interaction(tokens, of_top), weighted, n):
        out = out.join(part, "query_id", "left")
    return out.na.fill(0, ["mean_max", "min_max", "p25_max", "single", "rank1", "delta", "weighted", "hard", "n_tokens"])


def z_changes(before: DataFrame, after: DataFrame, spread: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean_z, std_z): change of each feature in units of its deviation over ``spread``."""
    size = spread.agg(*[F.stddev_samp(c).alias(f"_d_{c}") for c in columns])
    both = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns]).join(after.select(key, *columns), key).crossJoin(F.broadcast(size))
    z = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_b_{c}")) / F.col(f"_d_{c}")).alias("z")) for c in columns]))
    return both.select(z.alias("_z")).select("_z.*").groupBy("feature").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("std_z"))


def merged_sections(sections_: DataFrame, key: str, least: int) -> DataFrame:
    """Sections of fewer than ``least`` words joined with the next sibling under the same parent (V3), document by document."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for number, title, body in zip(g.number, g.title, g.body, strict=True):
            parent = number.rpartition(".")[0]
            if out and out[-1][1].split(";")[-1].rpartition(".")[0] == parent and len(out[-1][3].split()) < least:
                out[-1][1] += ";" + number
                out[-1][3] = (out[-1][3] + " " + title + " " + body).strip()
            else:
                out.append([g[key].iloc[0], number, title, body])
        return pd.DataFrame(out, columns=[key, "number", "title", "body"])

    ordered = sections_.withColumn("_n", F.transform(F.split("number", r"\."), lambda x: x.cast("int")))
    kind = sections_.schema[key].dataType.simpleString()
    return ordered.groupBy(key).applyInPandas(lambda g: run(g.sort_values("_n", key=lambda s: s.map(tuple))), f"{key} {kind}, number string, title string, body string")


def kept_tokens(tokens):
    """Tokens without special ones, bare word marks and punctuation."""
    return F.filter(tokens, lambda t: ~t.rlike(r"^(<[^>]*>|▁|[▁\p{Punct}]+)$"))
