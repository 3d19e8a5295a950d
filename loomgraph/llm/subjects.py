"""Subject areas of documents, by class-association rules and calibrated evidence."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

NO_AREA = "none"
_CLASS = "="  # no term begins with it
_WORD = re.compile(r"[^\W\d_一-鿿]+(?:['’-][^\W\d_一-鿿]+)*|[一-鿿]+")
_PASSAGE = re.compile(r"[.!?。！？\n\r]+")
LONGEST_PASSAGE = 40  # words; longer ones are cut
FEWEST_WORDS = 3
MOST_TERMS = 3  # terms of a rule

#: What the weights are drawn to where labels are few:
#: bias, votes (of 6), share of the votes, share of the passages (of a half).
PRIOR_WEIGHTS = (-16.0, 12.0, 20.0, 8.0)


def passages(text: str | None) -> list[list[str]]:
    """The passages of a text, each as its terms: words in lower case, and pairs of Han characters."""
    out = []
    for part in _PASSAGE.split((text or "").lower()):
        words = _WORD.findall(part)
        n = sum(len(w) if "一" <= w[0] <= "鿿" else 1 for w in words)
        if n < FEWEST_WORDS:
            continue
        for i in range(0, len(words), LONGEST_PASSAGE):
            terms: list[str] = []
            for w in words[i : i + LONGEST_PASSAGE]:
                if "一" <= w[0] <= "鿿":
                    terms += [w[j : j + 2] for j in range(len(w) - 1)]
                else:
                    terms.append(w)
            out.append(terms)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int) -> DataFrame:
    """``doc_id, text, areas`` of at most about ``most`` labelled documents, chosen by a hash of the id.

    Labels are compared without case and blanks; those that are no area, nor
    'none', are left out, and 'none' counts only alone.
    """
    known = areas.select(F.lower(F.trim("subject_area")).alias("area")).where("area <> ''").unionByName(
        areas.sparkSession.createDataFrame([(NO_AREA,)], "area string")
    ).distinct()
    given = labels.select("doc_id", F.lower(F.trim("subject_area")).alias("area")).join(known, "area", "left_semi")
    per_doc = given.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("area").alias("areas"))
    n = per_doc.count()
    if n > most:
        per_doc = per_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    some = F.filter("areas", lambda a: a != NO_AREA)
    per_doc = per_doc.select("doc_id", F.when(F.size(some) > 0, F.array_sort(some)).otherwise(F.array(F.lit(NO_AREA))).alias("areas"))
    # at most ``most`` rows, so the texts need not be shuffled
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(per_doc), "doc_id")


def _passage_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(d, list(dict.fromkeys(p)), list(a)) for d, t, a in zip(pdf["doc_id"], pdf["text"], pdf["areas"]) for p in passages(t)]
        yield pd.DataFrame(rows, columns=["doc_id", "terms", "areas"])


def mine_rules(
    sample: DataFrame,
    least_docs: int = 4,
    least_passages: int = 3,
    least_confidence: float = 0.5,
    least_lift: float = 2.0,
) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules ``terms -> area`` with their confidence, from ``doc_id, text, areas``.

    Terms are first screened by the documents they occur in; the passages,
    reduced to screened terms and their area, are the transactions of a parallel
    FP-growth.  A rule is redundant if one with fewer of its terms, for the same
    area, has at least its confidence.
    """
    n_docs = sample.count()
    if not n_docs:
        return []
    rows = cut_lineage(sample.mapInPandas(_passage_rows, "doc_id bigint, terms array<string>, areas array<string>"), "passages")
    pairs = rows.select("doc_id", F.explode("terms").alias("term"), "areas").dropDuplicates(["doc_id", "term"])
    prior = {r["area"]: r["n"] / n_docs for r in sample.select(F.explode("areas").alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = F.create_map(*[F.lit(x) for a, s in prior.items() for x in (a, s)])
    total = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    joint = pairs.select("term", F.explode("areas").alias("area")).groupBy("term", "area").agg(F.count(F.lit(1)).alias("k"))
    screened = joint.join(total, "term").where((F.col("area") != NO_AREA) & (F.col("n") >= least_docs))
    screened = screened.withColumn("conf", (F.col("k") + 0.5) / (F.col("n") + 2)).where((F.col("conf") >= least_confidence * 0.6) & (F.col("conf") >= F.least(least_lift * shares[F.col("area")], (1 + shares[F.col("area")]) / 2)))
    strength = {r["term"]: r["conf"] for r in screened.groupBy("term").agg(F.max("conf").alias("conf")).collect()}
    if not strength:
        return []

    def transactions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for terms, areas in zip(pdf["terms"], pdf["areas"]):
                kept = [t for t in terms if t in strength]
                if kept:
                    out.append([*kept, *(_CLASS + a for a in areas)])
            yield pd.DataFrame({"items": out})

    baskets = cut_lineage(rows.mapInPandas(transactions, "items array<string>"), "baskets")
    n = baskets.count()
    if not n:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least_passages / n), minConfidence=least_confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(_CLASS) & ~F.exists("antecedent", lambda t: t.startswith(_CLASS)))
    found = found.where(F.size("antecedent") <= MOST_TERMS).select("antecedent", F.element_at("consequent", 1).alias("area"), "confidence", "support")
    rules = [(tuple(sorted(r["antecedent"])), r["area"][1:], r["confidence"], r["support"]) for r in found.collect()]
    # the fewer the passages, the nearer to a half
    conf = {(x, a): (s * n + 1) / (s * n / c + 2) for x, a, c, s in rules if c > 0}
    return prune(conf)


def prune(conf: dict[tuple[tuple[str, ...], str], float]) -> list[tuple[tuple[str, ...], str, float]]:
    """Without the rules for no area and those that a rule with fewer terms makes redundant."""
    out = []
    for (x, a), c in sorted(conf.items()):
        subsets = [tuple(t for j, t in enumerate(x) if m >> j & 1) for m in range(1, 2 ** len(x) - 1)]
        if a != NO_AREA and not any(conf.get((y, a), 0) >= c for y in subsets):
            out.append((x, a, c))
    return out


class Matcher:
    """Rules indexed by their first term, as log odds by area code."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]], least: float = 0.6):
        self.least = least
        self.by_first: dict[str, list[tuple[frozenset, str, float, float]]] = defaultdict(list)
        for x, a, c in rules:
            self.by_first[x[0]].append((frozenset(x[1:]), a, c, math.log(c / (1 - c))))
        self.terms = {t for x, _, _ in rules for t in x}

    def vote(self, terms: list[str]) -> str | None:
        """The area with the most evidence (sum of log odds) among the rules a passage matches."""
        have = self.terms.intersection(terms)
        if not have:
            return None
        evidence: dict[str, float] = defaultdict(float)
        best: dict[str, float] = defaultdict(float)
        for t in have:
            for rest, a, c, odds in self.by_first.get(t, ()):
                if rest <= have:
                    evidence[a] += odds
                    best[a] = max(best[a], c)
        strong = [(e, a) for a, e in evidence.items() if best[a] >= self.least]
        return max(strong)[1] if strong else None

    def evidence(self, text: str | None) -> dict[str, tuple[float, float, float]]:
        """For each area voted for: votes (of 6), share of the votes, share of the passages (of a half)."""
        votes: Counter[str] = Counter()
        n = 0
        for p in passages(text):
            n += 1
            if a := self.vote(p):
                votes[a] += 1
        total = sum(votes.values())
        return {a: (min(c, 6) / 6, c / total, min(c / n, 0.5) / 0.5) for a, c in votes.items()}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn to ``PRIOR_WEIGHTS`` the more, the fewer the cases; bias first."""
    z = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array(PRIOR_WEIGHTS)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + ridge / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * (w - prior))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-6:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def calibrate(sample: DataFrame, rules: list[tuple[tuple[str, ...], str, float]]) -> tuple[float, ...]:
    """Weights that turn evidence into the probability that a document has the area."""
    shared = sample.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for pdf in batches:
            rows = [(*e, float(a in set(areas))) for t, areas in zip(pdf["text"], pdf["areas"]) for a, e in matcher.evidence(t).items()]
            yield pd.DataFrame(rows, columns=["votes", "of_votes", "of_passages", "y"])

    got = sample.mapInPandas(run, "votes double, of_votes double, of_passages double, y double").toPandas()
    return fit_weights(got[["votes", "of_votes", "of_passages"]].to_numpy(float), got["y"].to_numpy(float))


def score(documents: DataFrame, rules: list, weights: tuple[float, ...], threshold: float, most_areas: int) -> DataFrame:
    """``doc_id, areas: array<struct<area, probability>>`` of every document, the likeliest first."""
    shared = documents.sparkSession.sparkContext.broadcast((rules, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, w = shared.value
        matcher = Matcher(found)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                scored = []
                for a, e in matcher.evidence(t).items():
                    z = w[0] + sum(k * v for k, v in zip(w[1:], e))
                    scored.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), a))
                best = sorted((s for s in scored if s[0] >= threshold), key=lambda s: (-s[0], s[1]))[:most_areas]
                out.append([{"area": a, "probability": p} for p, a in best])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "areas": out})

    texts = documents.select("doc_id", "text").where("text is not null and text <> ''")
    return texts.mapInPandas(run, "doc_id bigint, areas array<struct<area:string,probability:double>>")


def assign_subjects(
    documents: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    most_labelled: int = 20_000,
    calibration_share: float = 0.5,
    threshold: float = 0.5,
    most_areas: int = 2,
) -> DataFrame:
    """``doc_id, subject_area, probability``: the areas each document is about, at most ``most_areas``.

    Rules and calibration are fitted on a sample of at most about
    ``most_labelled`` labelled documents; their number bounds what is broadcast.
    The weights come from ``calibration_share`` of them, by rules mined from the
    others, so that rules are not judged by the documents they come from; the
    rules themselves are then mined from all.
    Every document is scored whole: each passage votes for the area with the
    most rule evidence, and votes, share of votes and share of passages give the
    probability; an area comes out from ``threshold`` on.

    Null, empty and topicless texts, and texts too short for evidence, give no
    row; without labels there are no rows; ties go to the greater probability,
    then the smaller name; a repeated document gives repeated rows only if its
    id is repeated with different texts; other columns are ignored.
    """
    sample = cut_lineage(labelled_sample(documents, labels, areas, most_labelled), "labelled")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * calibration_share)
    weights = calibrate(sample.where(aside), mine_rules(sample.where(~aside)))
    scored = score(documents, mine_rules(sample), weights, threshold, most_areas).select("doc_id", F.explode("areas").alias("a"))
    return scored.select("doc_id", F.col("a.area").alias("subject_area"), F.col("a.probability").alias("probability"))


def subject_shares(found: DataFrame, n_documents: int) -> DataFrame:
    """``subject_area, documents, share``: how much of the corpus is about each area."""
    n = found.groupBy("subject_area").agg(F.count_distinct("doc_id").alias("documents"))
    return n.withColumn("share", F.col("documents") / F.lit(max(1, n_documents)))
