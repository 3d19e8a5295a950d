"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from loomgraph.session import cut_lineage


def sainte_lague(weights: dict[str, float], seats: int, caps: dict[str, int] | None = None) -> dict[str, int]:
    """``seats`` seats by highest quotients ``weight / (2 got + 1)``; none beyond ``caps``.

    Ties go to the smaller name.  Fewer seats are given if all caps are reached.
    """
    got = dict.fromkeys(weights, 0)
    cap = lambda k: seats if caps is None else caps.get(k, 0)
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    heap = [(-w, k) for k, w in exact.items() if cap(k) > 0]
    heapq.heapify(heap)
    left = seats
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < cap(k):
            heapq.heappush(heap, (-exact[k] / (2 * got[k] + 1), k))
    return got


def distinct_texts(documents: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Each text once, with its first document: ``text_key, doc_id, source, n_tokens``.

    Texts are encoded where they lie and leave only their digest, so the
    shuffle holds no text and combines copies before it.
    """
    has_text = F.col("text").rlike(r"[^\s\p{Z}​﻿]")
    rows = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), F.sha2("text", 256).alias("text_key"), F.when(has_text, F.col("text")).alias("text"))
    rows = rows.where("text is not null and source <> ''")
    aimed = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    rows = rows.join(aimed, "source", "left_semi")
    sized = count_tokens(rows, path=path).where("n_tokens > 0")
    first = sized.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("f"))
    return first.select("text_key", "f.doc_id", "f.source", "f.n_tokens")


def source_quotas(held: dict[str, int], aims: dict[str, tuple[float, int]], n_blocks: int) -> dict[str, int]:
    """Tokens to take of each source: the largest mix with the shares, in ``n_blocks`` equal blocks by highest quotients.

    ``aims``: share and most repeats.  A quota is within a block of its share of
    the mix, and no more than the source can give.
    """
    aims = {k: (s, r) for k, (s, r) in aims.items() if s and s > 0 and r and r > 0 and held.get(k)}
    if not aims:
        return {}
    whole = sum(s for s, _ in aims.values())
    room = {k: held[k] * r for k, (_, r) in aims.items()}
    total = int(min(Fraction(room[k]) * Fraction(whole) / Fraction(s) for k, (s, _) in aims.items()))
    n_blocks = max(1, min(n_blocks, total))
    block = Fraction(total, n_blocks)
    caps = {k: math.ceil(room[k] / block) for k in aims}
    got = sainte_lague({k: s for k, (s, _) in aims.items()}, n_blocks, caps)
    return {k: min(round(n * block), room[k]) for k, n in got.items()}


def shard_quotas(tokens: np.ndarray, repeats: int, quota: int, blocks_a_shard: int = 1024) -> np.ndarray:
    """Tokens to take of each shard of a source, whose sum is ``quota`` (if the source holds it).

    The quota's equal blocks, ``blocks_a_shard`` for each shard on average, go to
    the shards by highest quotients, none beyond what a shard can give: a shard
    of t tokens gets round(t / d) blocks for the one divisor d that gives out all
    of them, which is found by halving.  What rounding leaves is given to or
    taken from the shards with the most room.
    """
    room = tokens.astype(object) * repeats
    quota = min(int(quota), int(room.sum()))
    if quota <= 0:
        return np.zeros(len(tokens), dtype=object)
    seats = min(quota, blocks_a_shard * len(tokens))
    block = quota / seats
    most = np.ceil(room.astype(float) / block)
    t = tokens.astype(float)
    given = lambda d: np.minimum(np.floor(t / d + 0.5), most)
    low, high = t.max() / (4.0 * seats), 4.0 * t.sum() / seats + 1
    for _ in range(100):
        d = (low + high) / 2
        low, high = (d, high) if given(d).sum() >= seats else (low, d)
    want = np.array([min(int(n * block), r) for n, r in zip(given(low), room)], dtype=object)
    left = quota - int(want.sum())
    for i in np.argsort(-(room - want).astype(float), kind="stable") if left > 0 else np.argsort(-want.astype(float), kind="stable"):
        if not left:
            break
        step = min(left, room[i] - want[i]) if left > 0 else -min(-left, want[i])
        want[i] += step
        left -= step
    return want


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    n_blocks: int = 20_000,
    shard_tokens: int = 8_000_000,
    most_shards: int = 4096,
    seed: int = 20_240_501,
    path: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """The largest mix with the target shares: ``doc_id, source, n_tokens, repeats``.

    A text held by several documents counts once (its smallest doc_id, whose
    source it takes).  The mix is as large as the scarcest source allows when
    each of its texts occurs ``max_repeats`` times; its tokens form ``n_blocks``
    equal blocks, given to the sources by highest quotients, and a source's
    quota is given to its shards (of about ``shard_tokens`` tokens, by digest,
    larger ones where that would be more than ``most_shards``) in the same way.
    A shard's quota is whole passes over its texts and a rest, taken in an order
    set by ``seed`` up to the text at whose middle the rest ends.

    Sources without a target, targets without a text or with a share or repeats
    of null, zero or less, and rows with a null or blank source or text stay
    out; targets given twice count once (the larger share); the shares of the
    sources that have texts are scaled to 1.  An empty table gives an empty mix.
    Only one row for each source with a target reaches the driver; the shards of
    a source, ``most_shards`` rows at most, are apportioned in one task.
    """
    spark = documents.sparkSession
    texts = cut_lineage(distinct_texts(documents, targets, path), "texts")
    goals = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("repeats"))
    aims = {r["source"]: (r["share"], r["repeats"]) for r in goals.collect()}
    held = {r["source"]: r["tokens"] for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    n_shards = min(most_shards, max(1, round(sum(held.values()) / shard_tokens)))
    quotas = [(k, q, aims[k][1]) for k, q in source_quotas(held, aims, n_blocks).items() if q]
    quotas = spark.createDataFrame(quotas, "source string, quota bigint, most int")
    sharded = texts.withColumn("shard", F.pmod(F.xxhash64("text_key"), F.lit(n_shards)).cast("int"))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        want = shard_quotas(pdf["tokens"].to_numpy(), int(pdf["most"].iloc[0]), int(pdf["quota"].iloc[0]))
        tokens = [int(t) for t in pdf["tokens"]]
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "passes": [int(w) // t for w, t in zip(want, tokens)], "rest": [int(w) % t for w, t in zip(want, tokens)]})

    sizes = sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(quotas), "source")
    plan = sizes.groupBy("source").applyInPandas(apportion, "source string, shard int, passes bigint, rest bigint")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("text_key", F.lit(seed)), "doc_id")
    before = F.sum("n_tokens").over(w) - F.col("n_tokens")
    chosen = sharded.join(plan, ["source", "shard"]).withColumn("before", before)
    extra = (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("long")
    return chosen.select("doc_id", "source", "n_tokens", (F.col("passes") + extra).cast("int").alias("repeats")).where("repeats > 0")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: ``source, target_share, max_repeats, texts, tokens, actual_share, most_repeats``."""
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    goals = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    out = goals.join(got, "source", "left").na.fill(0, ["texts", "tokens", "most_repeats"])
    everything = Window.partitionBy(F.lit(1))  # one row a source
    return out.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(everything))
