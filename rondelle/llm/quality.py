"""Quality classifier: document evidence with host and path posteriors, by hierarchical empirical Bayes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_sized, stash, text_or_empty
from .simhash import let

#: Labelled rows that the document classifier is fitted on at most: those with
#: the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Probability of good quality below which a document is rejected.
KEEP_FROM = 0.5
#: Limits of what a document's own text can say, in log odds.
EVIDENCE = 8.0
#: Sites up to which the table of sites is broadcast; beyond it is joined by shuffle.
FEW_SITES = 100_000
FEATURES = ["symbols", "exclaims", "pipes", "capitals", "digits", "repeats", "newlines", "word_length", "log_words", "symbol_words"]


def features(text: Column) -> Column:
    """ARRAY<DOUBLE> of FEATURES of a whole text; the empty text has zeros."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda chars: F.regexp_count(text, F.lit(chars)) / n

    def of_words(ws: Column) -> Column:
        size = F.greatest(F.size(ws), F.lit(1)).cast("double")
        return F.array(
            share(r"[$%&*#@^~=<>{}\\[\\]]"), share("!"), share(r"\|"), share(r"\p{Lu}"), share("[0-9]"),
            1 - F.size(F.array_distinct(ws)) / size, share("\n"), n / size, F.log1p(size), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s,.;:'’-]{2,}")) / size,
        )

    return let(F.split(text, r"\s+"), of_words)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps on standardised features: (mean, scale, weights with bias last, base log odds)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    base = (y.sum() + 1) / (len(y) + 2)
    return mean, scale, w, math.log(base / (1 - base))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS):
    """Fit the document classifier on at most ``limit`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``limit`` labels
    rows = rows.select("doc_id", "quality", features(text_or_empty()).alias("x"))
    got = sorted((r["doc_id"], r["quality"], tuple(r["x"])) for r in rows.collect())
    y = np.array([q for _, q, _ in got], float)
    if len(got) < 2 or y.min() == y.max():
        base = (y.sum() + 1) / (len(y) + 2)
        k = len(FEATURES)
        return np.zeros(k), np.ones(k), np.r_[np.zeros(k), math.log(base / (1 - base))], math.log(base / (1 - base))
    return fit(np.array([x for *_, x in got]), y)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def beta_strength(mean: float, variance: float, noise: float) -> float:
    """Prior strength (in documents) of a level by moments: how alike its groups are beyond their sampling noise."""
    between = max(variance - noise, 1e-6)
    return min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)


def site_groups(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums of document_p by host and path, the global share, and the prior strengths of hosts and of paths.

    ``rows``: _host, _path, _site (both in one), _p. Sums are pre-aggregated before the shuffle; what
    comes out has one row per site and is written to the shared folder.
    """
    paths = stash(rows.groupBy("_host", "_path", "_site").agg(F.count("*").alias("_n"), F.sum("_p").alias("_good")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_host_n"), F.sum("_good").alias("_host_good")).withColumnRenamed("_host", "_h")
    g = hosts.agg(F.sum("_host_good").alias("good"), F.sum("_host_n").alias("n"), F.count("*").alias("k"), F.sum(F.lit(1) / F.col("_host_n")).alias("inv")).first()
    mu = min(max((g["good"] or 0.0) / (g["n"] or 1), 1e-4), 1 - 1e-4)
    v = hosts.agg(F.avg(F.pow(F.col("_host_good") / F.col("_host_n") - mu, 2)).alias("v")).first()["v"] or 0.0
    host_strength = beta_strength(mu, v, mu * (1 - mu) * (g["inv"] or 0.0) / max(g["k"], 1))
    groups = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    inner = groups.agg(F.avg(F.pow(F.col("_good") / F.col("_n") - F.col("_host_good") / F.col("_host_n"), 2)).alias("v"), F.avg(F.lit(1) / F.col("_n")).alias("noise")).first()
    return groups, mu, host_strength, beta_strength(mu, inner["v"] or 0.0, mu * (1 - mu) * (inner["noise"] or 0.0))


def with_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_from: float = KEEP_FROM, carry: list[str] | None = None) -> DataFrame:
    """Adds document_p, site_p, quality_p and kept to each row of docs.

    document_p is a logistic classifier's probability of good quality from the
    text alone. Each host's share of good documents is a Beta posterior around
    the global share, each path's (host and second column) one around its
    host's; the strengths of both priors come from the spread of the groups, so
    sparse sites stay near the level above. A document's own evidence is taken
    out of its site's sums before it is combined, as odds, with the site's.
    Whole texts are read, however long. Null texts are empty, null hosts and
    paths are groups of their own, repeated rows are scored each, equal texts of
    one site get equal scores. Without labels of both classes the classifier
    says the smoothed base rate. An empty table gives an empty result. Existing
    columns of the added names are replaced; other columns are kept (``carry``:
    only these).
    """
    added = ["document_p", "site_p", "quality_p", "kept"]
    mean, scale, w, base = train(docs, labels)
    weights = [(float(m), float(s), float(b)) for m, s, b in zip(mean, scale, w[:-1], strict=True)]

    def weigh(xs: Column) -> Column:
        total = F.lit(float(w[-1]))
        for i, (m, s, b) in enumerate(weights):
            total = total + (F.get(xs, i) - m) / s * b
        return total

    odds = F.greatest(F.least(let(features(text_or_empty()), weigh), F.lit(base + EVIDENCE)), F.lit(base - EVIDENCE))
    columns = [c for c in carry or docs.columns if c not in added]
    # features are computed once: rows are written with their odds, and sites are summed and joined from there
    site = F.to_json(F.struct(F.col(host).alias("host"), F.col(path).alias("path")), {"ignoreNullFields": "false"})
    rows = stash(docs.select(F.struct(*columns).alias("doc"), F.col(host).alias("_host"), F.col(path).alias("_path"), site.alias("_site"), odds.alias("_odds")), "odds")
    own = 1 / (1 + F.exp(-F.col("_odds")))
    groups, mu, host_strength, path_strength = site_groups(rows.select("_host", "_path", "_site", own.alias("_p")))
    groups = stash(groups.select("_site", "_n", "_good", "_host_n", "_host_good"), "groups")
    if groups.count() <= FEW_SITES:
        rows = rows.join(F.broadcast(groups), "_site")
    else:
        rows = join_sized(rows, groups, "_site", "_n", rows.count())
    host_p = (mu * host_strength + F.col("_host_good") - own) / (host_strength + F.col("_host_n") - 1)
    site_p = F.greatest(F.least((host_p * path_strength + F.col("_good") - own) / (path_strength + F.col("_n") - 1), F.lit(1 - 1e-4)), F.lit(1e-4))
    rows = rows.withColumn("document_p", own).withColumn("site_p", site_p)
    rows = rows.withColumn("quality_p", 1 / (1 + F.exp(base - F.col("_odds") - logit(F.col("site_p"))))).withColumn("kept", F.col("quality_p") >= keep_from)
    return rows.select("doc.*", *added)


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, document_p, site_p, quality_p, kept for each row of docs; see with_quality."""
    rows = with_quality(docs, labels, host, path, carry=["doc_id", host, path])
    return rows.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "document_p", "site_p", "quality_p", "kept")
