"""Lexical, vector and hybrid retrieval.  Query sets are answered all at once against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import sentences, tokens
from loomgraph.session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25  # the usual constants of BM25
RRF_K = 60


@dataclass
class Asked:
    """What is asked: ``queries`` (``query_id, set, asked``: the number of its terms), the distinct ``sets`` of terms as places in ``terms``."""

    queries: DataFrame
    sets: list[list[int]]
    terms: list[str]


def asked_sets(queries: DataFrame) -> Asked:
    """The distinct terms of each query ``query_id, text``; queries of the same terms are answered together, as one set.

    The driver holds the distinct sets, not the queries.  Queries without a term are left out.
    """
    rows = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
    rows = cut_lineage(rows.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "asked")
    sets = [r["terms"] for r in rows.select("terms").distinct().collect()]
    terms = sorted({t for x in sets for t in x})
    at = {t: i for i, t in enumerate(terms)}
    numbered = queries.sparkSession.createDataFrame(list(enumerate(sets)), "set int, terms array<string>")
    return Asked(rows.join(F.broadcast(numbered), "terms").select("query_id", "set", F.size("terms").alias("asked")), [[at[t] for t in x] for x in sets], terms)


def _coded(rows: DataFrame, terms: list[str], depth: int) -> DataFrame:
    """``id, length, codes``: of token lists (``depth`` 1) or lists of them (2), the places in ``terms`` of the tokens that are there; rows without any are left out.

    ``length`` counts all tokens.  The result is a few numbers a row, so later passes don't read texts again.
    """
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    kind = "array<int>" if depth == 1 else "array<array<int>>"

    def within(lists: pa.ListArray) -> np.ndarray:
        """The list ends over the flattened members."""
        return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in batches:
            levels, lists = [], b.column(1)
            for _ in range(depth):
                levels.append(within(lists))
                lists = lists.flatten()
            codes = pc.index_in(lists.cast(pa.string()), value_set=known)
            met = np.concatenate([[0], np.cumsum(codes.is_valid().to_numpy(zero_copy_only=False))])
            ends = met[levels[-1]]
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes.drop_null())
            top = ends
            if depth == 2:
                out, top = pa.ListArray.from_arrays(pa.array(levels[0], pa.int32()), out), ends[levels[0]]
            length = levels[-1] if depth == 1 else levels[1][levels[0]]
            kept = pa.array(np.diff(top) > 0)
            yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (b.column(0), pa.array(np.diff(length), pa.int64()), out)], ["id", "length", "codes"])

    return rows.mapInArrow(run, f"id bigint, length bigint, codes {kind}")


_LAST = np.iinfo(np.int64).max  # stands for a null id
_CELLS = 1 << 22  # cells of the table of terms by rows that a task holds


def _by_set(rows: DataFrame, asked: Asked, scorer: Callable, k: int | None, fields: str) -> DataFrame:
    """``set, id`` and ``fields`` (the score first) of the documents ``id, parts`` with a term of a set: all, or the ``k`` best of each set with their ``rank``.

    ``scorer(parts)`` gives a function from a set and the places of its terms
    to an array for each field and where there is a hit.  A task keeps its
    best ``k`` of each set and writes only these, so nothing grows with
    documents times sets; ties go to the smaller id.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked.sets)
    schema = f"set int, id bigint, {fields}"
    kinds = [pa.float64() if x.split()[1] == "double" else pa.int64() for x in fields.split(", ")]
    step = max(1, _CELLS // max(1, 20 * len(asked.terms)))

    def batch(sets: list, ids: list, values: list) -> pa.RecordBatch:
        ids = np.concatenate(ids)
        cols = [pa.array(np.concatenate(sets), pa.int32()), pa.array(ids, pa.int64(), mask=ids == _LAST)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(np.concatenate(v), t) for v, t in zip(zip(*values), kinds)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                ids, of = b.column(0).fill_null(_LAST).to_numpy(), scorer(b.column(1))
                out: tuple[list, list, list] = ([], [], [])
                for j, places in enumerate(shared.value):
                    values, hit = of(j, places)
                    if k and j in best and len(best[j][0]) == k:
                        hit = hit & (values[0] >= best[j][1][0][-1])
                    at = np.flatnonzero(hit)
                    if not len(at):
                        continue
                    found = ids[at], [v[at] for v in values]
                    if k is None:
                        for x, y in zip(out, (np.full(len(at), j), *found)):
                            x.append(y)
                        continue
                    if j in best:
                        found = np.concatenate([best[j][0], found[0]]), [np.concatenate(x) for x in zip(best[j][1], found[1])]
                    order = np.lexsort((found[0], -found[1][0]))[:k]
                    best[j] = found[0][order], [v[order] for v in found[1]]
                if out[0]:
                    yield batch(*out)
        if best:
            yield batch([np.full(len(i), j) for j, (i, _) in best.items()], [i for i, _ in best.values()], [v for _, v in best.values()])

    scored = rows.mapInArrow(run, schema)
    return scored if k is None else top_k(scored, k, group="set")


def to_queries(by_set: DataFrame, asked: Asked, whole: bool = False) -> DataFrame:
    """What was found for a set, for each of its queries.

    If it is ``whole`` and not the best of a set, it grows as documents times
    sets, which Spark's estimate doesn't see; it stays where it is and the queries
    go to it, as three numbers each.
    """
    return by_set.join(F.broadcast(asked.queries) if whole else asked.queries, "set").drop("set")


@dataclass
class Lexicon:
    """Documents as counts of query terms: ``rows`` (``id, parts``), ``idf`` of each term asked, the ``mean_length``."""

    rows: DataFrame
    asked: Asked
    idf: list[float]
    mean_length: float


def lexicon(queries: DataFrame, docs: DataFrame) -> Lexicon:
    """Documents ``id, text`` for BM25.

    Statistics cover all documents that have a token.  A term in more than half
    of them has a negative weight, which is replaced by a quarter of the mean
    weight of all terms.  Rows with one id count as one document.
    """
    asked = asked_sets(queries)
    toks = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    # the null term counts the documents
    each = toks.where(F.size("t") > 0).select(F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("t").alias("length"))
    stats = cut_lineage(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("tokens")), "terms")
    n, total = stats.where("term is null").select("df", "tokens").first() or (0, 0)
    raw = stats.where("term is not null").select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    wanted = docs.sparkSession.createDataFrame([(t,) for t in asked.terms], "term string")
    found = dict(raw.join(F.broadcast(wanted), "term").collect())
    idf = [EPSILON * mean if found.get(t, 0.0) < 0 else found.get(t, 0.0) for t in asked.terms]
    coded = _coded(toks, asked.terms, 1)
    rows = coded.groupBy("id").agg(F.collect_list(F.struct("length", "codes")).alias("parts"))
    return Lexicon(cut_lineage(rows, "lexicon"), asked, idf, total / n if n else 1.0)


def bm25_by_set(lex: Lexicon, k: int | None, most: list[float] | None = None) -> DataFrame:
    """``set, id, score, terms, whole`` (query terms met, of each row of a repeated id) of the documents with a term of the set, all or the best ``k``.

    ``score``, by which documents are ranked, has nine decimals, ``whole`` is the same unrounded.
    With ``most``, the best BM25 of each set, the score is the part of the linear score that comes from words.
    """
    idf, mean_length, count, asked = np.array(lex.idf), lex.mean_length, len(lex.asked.terms), [len(x) for x in lex.asked.sets]

    def scorer(parts: pa.ListArray) -> Callable:
        sizes = parts.value_lengths().to_numpy()
        length, codes = parts.flatten().flatten()
        length, doc = length.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        row, first, repeated = np.arange(len(doc)), None, bool((sizes > 1).any())
        if repeated:  # rows of one id and length are counted together
            pair, row = np.unique(np.stack([doc, length]), axis=1, return_inverse=True)
            doc, length, row = pair[0], pair[1], row.reshape(-1)
            first = np.searchsorted(doc, np.arange(len(sizes)))
        n = len(doc)
        at = codes.flatten().to_numpy().astype(np.int64) * n + np.repeat(row, codes.value_lengths().to_numpy())
        tf = np.bincount(at, minlength=count * n).reshape(count, n)
        w = idf[:, None] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        met = tf > 0

        def of(j: int, places: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
            score, terms = w[places].sum(0), met[places].sum(0)
            if repeated:
                score, terms = np.add.reduceat(score, first), np.add.reduceat(terms, first)
            if most is not None:
                score = 0.52 * (np.round(score, 9) / most[j] if most[j] > 0 else 0.0) + 0.13 * terms / asked[j]
            return [np.round(score, 9), terms, score], terms > 0

        return of

    return _by_set(lex.rows, lex.asked, scorer, k, "score double, terms bigint, whole double")


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, id, score, terms, whole, asked`` (query terms met, of how many) of every document ``id, text`` with a term of the query, or of the ``k`` best, with their ``rank``; ``score`` has nine decimals, ``whole`` all."""
    lex = lexicon(queries, docs)
    return to_queries(bm25_by_set(lex, k), lex.asked, k is None)


def top_k(scored: DataFrame, k: int, by: str = "score", group: str = "query_id") -> DataFrame:
    """The ``k`` best of each query with their ``rank``; ties go to the smaller id."""
    w = Window.partitionBy(group).orderBy(F.desc(by), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def sentence_hits(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, id, score, hits, sentences`` of the documents with a term of the query, or of the ``k`` best with their ``rank``."""
    by_set, asked = sentence_hits_by_set(queries, docs, k)
    return to_queries(by_set, asked, k is None)


def sentence_hits_by_set(queries: DataFrame, docs: DataFrame, k: int | None = None) -> tuple[DataFrame, Asked]:
    """``set, id, score, hits, sentences`` of the documents with a term of the set, or of the ``k`` best with their ``rank``; and what is asked.

    ``score`` is the most query terms that one sentence has, ``hits`` their sum
    over all sentences, ``sentences`` how many have one.  Rows with one id are
    laid upon each other, sentence by sentence.
    """
    asked = asked_sets(queries)
    count = len(asked.terms)
    split = docs.select("id", F.transform(sentences(F.coalesce("text", F.lit(""))), tokens).alias("t"))
    rows = cut_lineage(_coded(split, asked.terms, 2).groupBy("id").agg(F.collect_list("codes").alias("parts")), "sentences")

    def scorer(parts: pa.ListArray) -> Callable:
        sizes = parts.value_lengths().to_numpy()
        lists = parts.flatten()
        lengths = lists.value_lengths().to_numpy()
        said = lists.flatten()
        code, sentence = said.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(said)), said.value_lengths().to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)  # of each part
        longest = np.zeros(len(sizes), dtype=np.int64)
        np.maximum.at(longest, doc, lengths)
        starts = np.cumsum(longest) - longest
        place = np.arange(len(said)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[doc], lengths)
        once = np.unique(sentence * count + code)  # a term of a sentence
        kept, at = np.unique(place[once // count], return_inverse=True)
        table = np.bincount((once % count) * len(kept) + at, minlength=count * len(kept)).reshape(count, len(kept)).astype(np.int32)
        first = np.searchsorted(kept, starts)  # each document has a term

        def of(j: int, places: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
            n = table[places].sum(0, dtype=np.int32)
            best = np.maximum.reduceat(n, first).astype(np.int64)
            return [best.astype(float), np.add.reduceat(n, first).astype(np.int64), np.add.reduceat((n > 0).astype(np.int64), first)], best > 0

        return of

    return _by_set(rows, asked, scorer, k, "score double, hits bigint, sentences bigint"), asked


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = 1024) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest ``id, embedding`` of each ``query_id, embedding``.

    Queries go out in blocks of ``block`` vectors, the bound of what a task
    holds; a batch of rows is scored by one matrix product and leaves only its
    best ``k`` for each query, so the shuffle carries no vectors.  ``cosine``, or
    ``l2`` for 1 minus the squared distance.  Rows without a vector, of another
    length or of norm zero are left out.
    """
    spark = vectors.sparkSession
    asked = queries.where("query_id is not null and embedding is not null").orderBy("query_id").toLocalIterator()
    out, part = None, []

    def scored(part: list) -> DataFrame:
        ids, m = [q for q, _ in part], np.array([v for _, v in part], dtype=float)
        shared = spark.sparkContext.broadcast((ids, m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qs, q = shared.value
            for pdf in batches:
                fits = [e is not None and len(e) == q.shape[1] and np.any(e) for e in pdf["embedding"]]
                rows = pdf[fits]
                if rows.empty:
                    continue
                x, ids = np.array(rows["embedding"].tolist(), dtype=float), rows["id"].to_numpy()
                if metric == "cosine":
                    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ q.T
                else:
                    s = 1 - ((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1)[None, :])
                for j, name in enumerate(qs):
                    best = np.lexsort((ids, -s[:, j]))[:k]
                    yield pd.DataFrame({"query_id": name, "id": ids[best], "score": s[best, j]})

        return vectors.select("id", "embedding").mapInPandas(run, "query_id bigint, id bigint, score double")

    for r in asked:
        part.append((r["query_id"], r["embedding"]))
        if len(part) == block:
            out, part = scored(part) if out is None else out.unionByName(scored(part)), []
    if part:
        out = scored(part) if out is None else out.unionByName(scored(part))
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    return top_k(out, k)


def fused(channels: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists ``query_id, id, rank``: ``query_id, id, score, channels, rank``."""
    rows = None
    for df, weight in channels:
        part = df.select("query_id", "id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("channels")), k)


def ranked_keywords(nodes: DataFrame, keywords: list[str]) -> DataFrame:
    """``id, name, matched, score``: points for each keyword in a node's name, aliases and description."""

    def points(k: str) -> Column:
        name, q = F.lower("name"), F.lit(k)
        alias = F.transform("aliases", F.lower)
        return (
            F.when(name == q, 10).otherwise(0) + F.when(F.array_contains(alias, q), 9).otherwise(0) + F.when(F.contains(name, q), 6).otherwise(0)
            + F.when(F.exists(alias, lambda a: F.contains(a, q)), 5).otherwise(0) + F.when(F.contains(name, q) & F.lit(len(k) >= 2), 3).otherwise(0)
            + F.when(F.contains(F.lower("description"), q), 2).otherwise(0)
        )

    each = F.array(*[F.coalesce(points(k), F.lit(0)) for k in keywords])
    rows = nodes.select("id", "name", each.alias("p"))
    matched, score = F.size(F.filter("p", lambda x: x > 0)), F.aggregate("p", F.lit(0), lambda s, x: s + x)
    return rows.select("id", "name", matched.cast("bigint").alias("matched"), score.cast("bigint").alias("score")).where("matched > 0")
