"""Quality classifier: document evidence with host and path posteriors, shrunk by hierarchical empirical Bayes.

Evidence: two logistic regressions (good quality; toxic) on the shape of a text and on words and their beginnings,
fitted on a bounded sample of labelled documents. A document's evidence is the log odds of "good and not toxic".
Sites: a beta prior on the mean evidence of all documents, then of each host, then of each path within its host; how
strongly sparse ones are drawn to the level above is estimated from the spread of the means of the level itself. What a
document's site says of it is told by the other documents there: its own evidence is taken out of host and path.
The documents have no url: source stands for the host and lang for the path, unless other columns are named.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, giving_back, settle, small

#: Labelled documents to fit on, at most (least hash of id).
SAMPLE = 12_000
#: Words and beginnings in the model, at most, of those in LEAST labelled documents or more.
TERMS, LEAST = 4096, 8
BEGINNINGS = (4, 5, 6)
#: Ridge on the weights of shape and of terms, for quality (which shape tells) and toxicity (which terms tell).
RIDGES = {"q": (1e-4, 1e-2), "t": (1e-3, 3e-4)}
MEMO = 500_000
#: How much a site's log odds count beside a document's own.
SITE_WEIGHT = 0.5
WORD = re.compile(r"[^\W\d_]+")
UPPERS, DIGITS, STOPS, MARKS = (bytes(b for b in range(128) if f(chr(b))) for f in (str.isupper, str.isdigit, lambda c: c in ".,;:?'\"-()", lambda c: c.isprintable() and not c.isalnum() and c not in " .,;:?'\"-()"))


def terms_of(word: str) -> list[str]:
    return [f"{word} "] + [word[:k] for k in BEGINNINGS if len(word) > k]


def shape(text: str) -> tuple[list[float], Counter]:
    """Numbers on a text that do not depend on its language, and its distinct words with their counts."""
    words = WORD.findall(text.lower())
    count, raw = Counter(words), text.encode()
    size, n, lines = max(len(raw), 1), max(len(words), 1), [x for x in text.split("\n") if x]
    share = lambda these: (len(raw) - len(raw.translate(None, these))) / size
    return [
        np.log1p(len(words)),
        len(count) / n / (1 + np.log1p(n) / 10),
        share(UPPERS),
        share(DIGITS),
        share(STOPS),
        min(share(MARKS), 0.2),
        min(sum(map(len, words)) / n, 20.0),
        max(count.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
    ], count


def sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, quality, toxic of at most SAMPLE labelled documents."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return settle(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(settle(some, "labels")), "doc_id"), "labelled")


def list_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for text, q, t in zip(b["text"], b["quality"], b["toxic"]):
            own = sorted({x for w in shape(text)[1] for x in terms_of(w)})
            if own:
                yield pd.DataFrame({"term": own, "q": int(q == 1), "t": int(t == 1)})


def chosen(sample: DataFrame) -> list[str]:
    """The terms that tell most of either label: by the larger G statistic of its two tables."""
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("q"), F.sum((F.col("toxic") == 1).cast("int")).alias("t")).first()
    if not n["n"]:
        return []
    counts = sample.mapInPandas(list_terms, "term string, q int, t int").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("q").cast("double").alias("q"), F.sum("t").cast("double").alias("t")).where(F.col("n") >= LEAST)

    def g(k: str) -> Column:
        total, ones = F.lit(float(n["n"])), F.lit(float(n[k]))
        part = lambda x, row, col: F.when((x > 0) & (row > 0) & (col > 0), x * F.ln(x * total / (row * col))).otherwise(0.0)
        a, rest = F.col(k), total - F.col("n")
        return part(a, F.col("n"), ones) + part(F.col("n") - a, F.col("n"), total - ones) + part(ones - a, rest, ones) + part(rest - (ones - a), rest, total - ones)

    return [r["term"] for r in counts.orderBy(F.desc(F.greatest(g("q"), g("t"))), "term").limit(TERMS).select("term").collect()]


def fit(dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, terms: int, ridge: tuple[float, float] = (1e-4, 1e-2), steps: int = 250) -> np.ndarray:
    """Weights of intercept, dense columns and terms: logistic regression with a ridge, by Adam on all rows."""
    n = len(y)
    w = np.zeros(1 + dense.shape[1] + terms)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[0] = np.log(p / (1 - p))
    if y.min(initial=1) == y.max(initial=0):
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        z = w[0] + dense @ w[1 : 1 + dense.shape[1]] + np.bincount(rows, weights=w[1 + dense.shape[1] :][cols], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.r_[e.sum(), e @ dense, np.bincount(cols, weights=e[rows], minlength=terms)] + np.r_[0, ridge[0] * w[1 : 1 + dense.shape[1]], ridge[1] * w[1 + dense.shape[1] :]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def model(sample: DataFrame) -> dict:
    """centre, scale, and for both labels the intercept, dense weights and term weights."""
    terms = chosen(sample)
    place = {t: i for i, t in enumerate(terms)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [shape(t) for t in b["text"]]
            hits = [np.array([place[x] for w in count for x in terms_of(w) if x in place], np.int32).tobytes() for _, count in both]
            yield pd.DataFrame({"dense": [np.array(d).tobytes() for d, _ in both], "hits": hits, "q": b["quality"], "t": b["toxic"]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # SAMPLE rows at most; one task fits them, so that the driver need not hold them
        got = pd.concat([pd.DataFrame({"dense": [], "hits": [], "q": [], "t": []}), *batches])
        if not len(got):
            return
        dense = np.frombuffer(b"".join(got["dense"])).reshape(len(got), -1)
        centre, scale = dense.mean(0), dense.std(0) + 1e-6
        rows = np.repeat(np.arange(len(got), dtype=np.int32), [len(h) // 4 for h in got["hits"]])
        cols = np.frombuffer(b"".join(got["hits"]), np.int32)
        k = dense.shape[1]
        both = [fit((dense - centre) / scale, rows, cols, (got[c] == 1).to_numpy(float), len(place), RIDGES[c]) for c in ("q", "t")]
        yield pd.DataFrame({"model": [pickle.dumps({"centre": centre, "scale": scale, "start": [float(w[0]) for w in both], "dense": [w[1 : 1 + k] for w in both], "terms": [w[1 + k :] for w in both]})]})

    got = sample.mapInPandas(features, "dense binary, hits binary, q int, t int").repartition(1).mapInPandas(giving_back(fitted), "model binary").collect()
    if not got:
        return {}
    learnt = pickle.loads(got[0]["model"])
    return learnt | {"terms": {t: (float(learnt["terms"][0][i]), float(learnt["terms"][1][i])) for t, i in place.items()}}


def evidence(docs: DataFrame, learnt: dict, kind: str) -> DataFrame:
    """doc_id, text_hash, host, path, words, odds: the log odds that each document is good and not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # TERMS terms at most

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, memo = shared.value, {}
        for b in batches:
            odds, words = [], []
            for text in b["text"]:
                dense, count = shape(text)
                words.append(len(count))
                if not m:
                    odds.append(np.inf)
                    continue
                x = (np.array(dense) - m["centre"]) / m["scale"]
                q, t = (s + float(w @ x) for s, w in zip(m["start"], m["dense"]))
                for w in count:
                    own = memo.get(w)
                    if own is None:
                        hits = [h for k in terms_of(w) if (h := m["terms"].get(k))]
                        own = memo[w] = (sum(h[0] for h in hits), sum(h[1] for h in hits)) if hits else (0.0, 0.0)
                    q += own[0]
                    t += own[1]
                p = -np.logaddexp(0, -q) - np.logaddexp(0, t)  # log probability of both
                odds.append(p - np.log(-np.expm1(min(p, -1e-12))))
            if len(memo) > MEMO:
                memo = {}
            yield b[["doc_id", "text_hash", "host", "path"]].assign(words=words, odds=odds)

    return docs.mapInPandas(giving_back(score), f"doc_id {kind}, text_hash long, host string, path string, words long, odds double")


def strength(spread: float, noise: float, mean: float) -> float:
    """Prior counts for which a beta distribution of this mean has the spread that noise leaves."""
    own = max(spread - noise, 1e-9)
    return float(np.clip(mean * (1 - mean) / own - 1, 1.0, 1e6))


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, text_hash, host, path, p_document, p_site, p_good, keep: one row per row of docs.

    keep: p_good of a half or more, and a word at all: null, empty and wordless texts are rejected. Null hosts and
    paths are values of their own; repeated rows are judged alike. Without usable labels every document with a word is
    kept. An empty table gives an empty one; other columns are not read, whatever their names. Texts of any length are
    read whole. p_good of exactly a half keeps. A document alone at its site has what the level above says.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    # ids go through Python as strings, which are exact beside nulls
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path"), F.coalesce(docs[text], F.lit("")).alias("text"))
    learnt = model(sampled(spark, rows, labels.withColumn("doc_id", F.col("doc_id").cast("string"))))
    scored = settle(evidence(rows, learnt, "string"), "evidence").withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    sites = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s")), "sites")
    hosts = sites.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("nh"), F.sum("s").alias("sh"))
    top = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip((top["s"] or 0.0) / (top["n"] or 1.0), 1e-6, 1 - 1e-6))
    weigh = lambda n, m, at: [F.sum(n * F.pow(m - at, 2)).alias("v"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")]
    a = hosts.agg(*weigh(F.col("nh"), F.col("sh") / F.col("nh"), F.lit(mean))).first()
    noise = lambda r: mean * (1 - mean) * r["k"] / max(r["n"] or 0, 1)
    k_host = strength((a["v"] or 0.0) / max(a["n"] or 0, 1), noise(a), mean)
    both = sites.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    shrunk = (k_host * mean + F.col("sh")) / (k_host + F.col("nh"))
    b = both.agg(*weigh(F.col("n"), F.col("s") / F.col("n"), shrunk)).first()
    k_path = strength((b["v"] or 0.0) / max(b["n"] or 0, 1), noise(b), mean)
    table = settle(both.select("h", F.col("path").alias("q"), "nh", "sh", "n", "s"), "sites")
    out = scored.join(small(table), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    p = F.col("p")
    of_host = (k_host * mean + F.col("sh") - p) / (k_host + F.col("nh") - 1)
    of_site = F.least(F.greatest((k_path * of_host + F.col("s") - p) / (k_path + F.col("n") - 1), F.lit(1e-9)), F.lit(1 - 1e-9))
    out = out.withColumn("p_site", of_site)
    site = F.ln(F.col("p_site") / (1 - F.col("p_site"))) - float(np.log(mean / (1 - mean)))
    good = 1 / (1 + F.exp(-(F.col("odds") + SITE_WEIGHT * site)))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "host", "path", p.alias("p_document"), "p_site", good.alias("p_good"), ((good >= 0.5) & (F.col("words") > 0)).alias("keep"))


def kept(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """docs without the documents that the classifier rejects; rows that repeat id and text stay or go together."""
    found = judged(spark, docs, labels, doc_id=doc_id, text=text, **names)
    d, h = free(docs, "__d"), free(docs, "__h")
    bad = small(settle(found.where(~F.col("keep")).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "rejected"))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[d]) & (F.xxhash64(docs[text]) == bad[h]), "left_anti")
