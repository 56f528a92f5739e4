"""Quality and toxicity classifier with hierarchical empirical Bayes.

A document's evidence is a log likelihood ratio from a logistic model over
style and word-family features, fitted on a bounded sample of labelled rows.
Sites are a hierarchy: all documents, hosts, paths of a host.  The rate of a
path is its documents' soft counts shrunk toward its host's rate, the host's
toward the global rate, with prior strengths estimated from the spread between
sites by the method of moments.  A document's posterior combines its evidence
with its path's rate, so sparse sites follow the global prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, release, slices, store

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 16384
FAMILIES = 1024
MIN_SUPPORT = 4
MIN_Z = 3.5
PREFIXES = (4, 5, 6, 7)
N_FEATURES = 12
_WORDS = 100_000


def units(word: str) -> list[str]:
    """A word's families: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _bare(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}<>«»%&$#*|-")


class Featurizer:
    """Style and word-family features of a text; word properties are kept in a bounded table."""

    def __init__(self, toxic: dict[str, float]):
        self.toxic = toxic
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, 6))

    def _add(self, w: str) -> int:
        i = self.index[w] = len(self.index)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        symbols = sum(not c.isalnum() for c in w)
        score = max((self.toxic.get(u, 0.0) for u in units(_bare(w))), default=0.0) if self.toxic else 0.0
        self.table[i] = (len(w), symbols, symbols == len(w), len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum(),
                         sum(c.isdigit() for c in w), score)
        return i

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(N_FEATURES)
        words = text.split() if text else []
        if not words:
            return out
        if len(self.index) > _WORDS:
            self._reset()
        get, add = self.index.get, self._add
        idx = np.array([i if (i := get(w)) is not None else add(w) for w in words])
        t = self.table[idx]
        n, total = len(idx), t.sum(0)
        counts = np.bincount(np.unique(idx, return_inverse=True)[1])
        lines = [x for x in text.split("\n") if x]
        hits = t[:, 5] > 0
        c = int(hits.sum())
        out[:] = (math.log1p(n), total[1] / total[0], total[2] / n, total[3] / n, 1 - len(counts) / n,
                  counts.max() / n if n >= 20 else 0.0, (idx[1:] == idx[:-1]).mean() if n > 1 else 0.0,
                  1 - len(set(lines)) / max(1, len(lines)), total[4] / total[0], math.log1p(c), 100 * c / n,
                  math.log1p(total[5]))
        return out


@dataclass
class Model:
    toxic: dict[str, float] = field(default_factory=dict)
    center: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: dict[str, np.ndarray] = field(default_factory=dict)      # of (1, features); absent: no evidence
    base: dict[str, float] = field(default_factory=lambda: {"good": 0.5, "toxic": 0.5})

    def evidence(self, x: np.ndarray, head: str) -> float:
        if head not in self.weights:
            return 0.0
        w = self.weights[head]
        z = float(w[0] + w[1:] @ ((x - self.center) / self.scale))
        return max(-12.0, min(12.0, z - _logit(self.base[head])))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _family_counts(batches):
    """For each batch: documents and toxic documents by family and fold (pre-aggregated)."""
    schema = pa.schema([("unit", pa.string()), ("fold", pa.int32()), ("n", pa.int64()), ("t", pa.int64())])
    for batch in slices(batches):
        n: dict[tuple, int] = {}
        t: dict[tuple, int] = {}
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
            for u in {(u, fold) for w in set(text.split()) for u in units(_bare(w))}:
                n[u] = n.get(u, 0) + 1
                if toxic:
                    t[u] = t.get(u, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([u[0] for u in n], pa.string()), pa.array([u[1] for u in n], pa.int32()),
                                          pa.array(list(n.values()), pa.int64()), pa.array([t.get(u, 0) for u in n], pa.int64())], schema=schema)


def _families(rows: DataFrame) -> dict[str, dict[str, float]]:
    """Word families that tell toxic texts, by fold (``0``, ``1`` and ``all``),
    with their log odds; at most ``FAMILIES`` each."""
    totals = {x["fold"]: (x["n"], x["t"]) for x in rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("t")).collect()}
    totals["all"] = tuple(sum(v[i] for v in totals.values()) for i in (0, 1))
    counts = rows.select("text", F.col("toxic") == 1, "fold").mapInArrow(_family_counts, "unit string, fold int, n long, t long")
    counts = store(counts.where(F.length("unit") > 1).groupBy("unit").agg(
        F.sum("n").alias("n_all"), F.sum("t").alias("t_all"),
        *(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}") for f in (0, 1) for c in ("n", "t")))
        .where(F.col("t_all") >= MIN_SUPPORT), "families")
    out = {}
    for fold, (docs, toxic) in totals.items():
        out[str(fold)] = {}
        if not 0 < toxic < docs:
            continue
        n, t = F.col(f"n_{fold}"), F.col(f"t_{fold}")
        odds = F.log((t + 0.5) / (toxic + 1)) - F.log((n - t + 0.5) / (docs - toxic + 1))
        expect = n * (toxic / docs)
        z = (t - expect) / F.sqrt(expect + 1)
        best = (counts.where(t >= MIN_SUPPORT).select("unit", odds.alias("odds"), z.alias("z"))
                .where((F.col("odds") >= 1.5) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "unit").limit(FAMILIES))
        out[str(fold)] = {x["unit"]: float(x["odds"]) for x in best.collect()}
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, chosen by the hash of the id.

    Labels that are null, texts that are null or empty, and labels without a
    document are not used; of repeated labels the largest counts.  Without
    labels, or with one class only, that head gives no evidence.
    """
    lab = labels.groupBy(F.col("doc_id").alias("lid")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    lab = lab.where("good is not null and toxic is not null and lid is not null")
    chosen = lab.orderBy(F.xxhash64("lid"), "lid").limit(sample_rows)              # two integers and an id: bounded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    rows = store(rows.join(F.broadcast(chosen), F.col("id") == F.col("lid"))
                 .select("text", "good", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("fold")), "quality-sample")
    families = _families(rows)
    model = Model(toxic=families["all"])

    def make():
        # a row's features come from the families of the other half, so that the weights are honest
        feats = {f: Featurizer(families.get(str(1 - f), {})) for f in (0, 1)}
        return lambda text, good, toxic, fold: (feats[fold](text).tolist(), int(good == 1), int(toxic == 1))

    fitted = map_rows(rows.select("text", "good", "toxic", "fold"), make, "x array<double>, good int, toxic int").collect()
    if fitted:                                                                     # at most sample_rows short rows
        x = np.array([r["x"] for r in fitted])
        model.center, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        for head in ("good", "toxic"):
            y = np.array([r[head] for r in fitted], float)
            model.base[head] = float((y.sum() + 1) / (len(y) + 2))
            if 0 < y.sum() < len(y):
                model.weights[head] = fit_logistic((x - model.center) / model.scale, y)
    return model


HEADS = ("good", "toxic")


def _soft(head: str, base: float):
    """A document's soft count: its probability from its own evidence and the base rate."""
    return 1 / (1 + F.exp(-(F.col(f"ev_{head}") + _logit(base))))


def _strength(n, s, rate, groups: int, total: int):
    """Prior strength by the method of moments: rate (1 - rate) over the variance between sites beyond sampling noise."""
    within = F.first(rate * (1 - rate))
    spread = F.sum(n * F.pow(s / n - rate, 2)) / total - within * groups / total
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), within / F.greatest(spread, F.lit(1e-9)) - 1))


def sites(ev: DataFrame, base: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """Sums of the paths and their hosts, ``host, path, n, hn`` and for each head
    ``s_<head>, hs_<head>``, and the global rates ``pi_<head>`` and prior strengths
    ``k_host_<head>``, ``k_path_<head>`` (single numbers)."""
    sums = store(ev.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(_soft(h, base[h])).alias(f"s_{h}") for h in HEADS)), "paths")
    hosts = store(sums.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{h}").alias(f"hs_{h}") for h in HEADS)), "hosts")
    every = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)).alias("n"), F.count("*").alias("m"), *(F.coalesce(F.sum(f"hs_{h}"), F.lit(0.0)).alias(h) for h in HEADS)).first()
    k = {f"pi_{h}": (every[h] + base[h]) / (every["n"] + 1) for h in HEADS}
    total = max(1, every["n"])
    found = hosts.agg(*(_strength(F.col("hn"), F.col(f"hs_{h}"), F.lit(k[f"pi_{h}"]), every["m"], total).alias(f"k_host_{h}") for h in HEADS)).first().asDict()
    k |= {x: v or 1.0 for x, v in found.items()}
    joined = sums.join(hosts, "host")
    rated = joined.select("*", *(_rate(F.col(f"hs_{h}"), F.col("hn"), k[f"k_host_{h}"], F.lit(k[f"pi_{h}"])).alias(f"hr_{h}") for h in HEADS))
    paths = max(1, sums.count())
    found = rated.agg(*(_strength_of_paths(h, paths, total).alias(f"k_path_{h}") for h in HEADS)).first().asDict()
    return joined, k | {x: v or 1.0 for x, v in found.items()}


def _strength_of_paths(head: str, groups: int, total: int):
    """As ``_strength``; each path has its host's rate, so the noise is a mean over the paths."""
    rate, n = F.col(f"hr_{head}"), F.col("n")
    within = F.sum(n * rate * (1 - rate)) / total
    spread = F.sum(n * F.pow(F.col(f"s_{head}") / n - rate, 2)) / total - within * groups / total
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), within / F.greatest(spread, F.lit(1e-9)) - 1))


def _rate(s, n, strength: float, prior):
    return (s + strength * prior) / (n + strength)


def prior(head: str, base: float, k: dict[str, float]):
    """The rate of a row's path without the row itself, whose evidence is counted
    once: its soft count is taken out of its path and its host."""
    own = _soft(head, base)
    host = _rate(F.col(f"hs_{head}") - own, F.col("hn") - 1, k[f"k_host_{head}"], F.lit(k[f"pi_{head}"]))
    return _rate(F.col(f"s_{head}") - own, F.col("n") - 1, k[f"k_path_{head}"], host)


def _logit_col(p):
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             path_col: str = "lang", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``p_good``, ``p_toxic``, their
    path's rates and ``kept``.  Texts are read twice, for the site rates and for
    the rows themselves; without the text in ``carry``, once.

    ``kept`` is p_good >= threshold and p_toxic < threshold.  A null or empty
    text has no evidence, so its path's rates decide.  Null hosts and paths are
    sites of their own.  Repeated rows count as rows; an empty table gives no
    rows; without labels all rates are 1/2 and everything is kept but by tie.
    Columns of ``docs`` named like the results are replaced.
    """
    model = train(docs, labels, id_col, text_col, sample_rows)
    base_good, base_toxic = model.base["good"], (model.base["toxic"] if model.weights.get("toxic") is not None else 0.01)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        feats = Featurizer(model.toxic)
        for batch in texts:
            x = [feats(t) if t else None for t in batch]
            yield pd.DataFrame({"good": [0.0 if v is None else model.evidence(v, "good") for v in x],
                                "toxic": [0.0 if v is None else model.evidence(v, "toxic") for v in x]})
        release()

    # not to be copied by the optimizer: each row is evaluated once in a pass
    udf = F.pandas_udf(scored, "good double, toxic double").asNondeterministic()
    host, path = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    own = [c for c in (carry or docs.columns) if c not in ("p_good", "p_toxic", "rate_good", "rate_toxic", "kept")]
    ev = docs.select(*own, host.alias("__host"), path.alias("__path"), udf(F.col(text_col)).alias("__ev"))
    if text_col in own:
        light = store(ev.select("__host", "__path", "__ev"), "evidence")
    else:
        light = ev = store(ev, "evidence")
    light = light.select(F.col("__host").alias("host"), F.col("__path").alias("path"),
                         F.col("__ev.good").alias("ev_good"), F.col("__ev.toxic").alias("ev_toxic"))
    base = {"good": base_good, "toxic": base_toxic}
    known, k = sites(light, base)
    site = F.struct(*(c for c in known.columns if c not in ("host", "path"))).alias("__s")
    known = store(known.select(F.col("host").alias("__site"), F.col("path").alias("__site_path"), site), "rates")
    out = ev.join(known, (F.col("__host") == F.col("__site")) & (F.col("__path") == F.col("__site_path")))
    own = [F.col(c) for c in own]
    out = out.select(F.struct(*own).alias("__own"), "__s.*", F.col("__ev.good").alias("ev_good"), F.col("__ev.toxic").alias("ev_toxic"))
    out = out.select("*", *(prior(h, base[h], k).alias(f"rate_{h}") for h in HEADS))
    out = out.select("*", *((1 / (1 + F.exp(-(F.col(f"ev_{h}") + _logit_col(F.col(f"rate_{h}")))))).alias(f"p_{h}") for h in HEADS))
    return (out.select("__own.*", "p_good", "p_toxic", "rate_good", "rate_toxic")
            .withColumn("kept", (F.col("p_good") >= threshold) & (F.col("p_toxic") < threshold)))
