"""Mixing sources to target weights (problem 7).

Every document has a soft membership in the target sources and in "other" (all sources without a target):
what a classifier trained on the labelled documents makes of its text, together with its label where it
has one. Projected gradient descent fits a rate per document (how often it is used, between 0 and what its
source allows) so that the expected tokens of each source meet its target, and those of "other" are none.
Rates then become whole repeats by a hash of the document, with limits per source that bring the tokens as
near to the fit as the documents allow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .tokens import TOKEN_PATTERN

SAMPLE = 6000  # labelled documents that the classifier is trained on, at most
FEATURES = 1024
EPOCHS = 60
LABEL_TRUST = 0.99  # probability that a label names the domain of its text
STEPS, TOLERANCE = 100, 2e-5  # the fit has converged when a step moves no source by more than this share of all tokens
BUCKETS = 2048  # of the hash that turns rates into repeats
OTHER = ""  # the domain of documents whose source has no target
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_LINE_START = re.compile(r"(?m)^\s*(\S+)")


def source_name(column: Column) -> Column:
    """A source in one spelling: trimmed, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


@lru_cache(200_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % FEATURES


def bag(text: str | None) -> np.ndarray:
    """Hashed word, mark and line-start counts of a text, damped and of length 1."""
    if not text:
        return np.zeros(FEATURES, np.float32)
    lower = text.lower()
    ids = [_bucket(t) for t in _WORD.findall(lower)] + [_bucket("^" + t) for t in _LINE_START.findall(lower)]
    x = np.log1p(np.bincount(ids, minlength=FEATURES).astype(np.float32)) if ids else np.zeros(FEATURES, np.float32)
    return x / max(1e-9, float(np.linalg.norm(x)))


class SourceClassifier:
    """Softmax regression on hashed words."""

    def __init__(self, classes: list[str], weights: np.ndarray):
        self.classes, self.weights = classes, weights

    @classmethod
    def train(cls, bags: np.ndarray, labels: list[str], epochs: int = EPOCHS) -> SourceClassifier:
        classes = sorted(set(labels))
        x = np.hstack([bags, np.ones((len(bags), 1), np.float32)])
        y = np.eye(len(classes), dtype=np.float32)[[classes.index(k) for k in labels]]
        w = np.zeros((x.shape[1], len(classes)), np.float32)
        step = np.zeros_like(w)
        for _ in range(epochs):  # gradient descent with momentum on the cross entropy
            p = _softmax(x @ w)
            step = 0.9 * step - 8.0 * (x.T @ (p - y) / len(x) + 1e-5 * w)
            w = w + step
        return cls(classes, w)

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        x = np.hstack([np.stack([bag(t) for t in texts]), np.ones((len(texts), 1), np.float32)])
        return _softmax(x @ self.weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_classifier(documents: DataFrame, listed: list[str], sample: int = SAMPLE, held_out: bool = False) -> SourceClassifier | None:
    """A classifier of the listed sources and ``OTHER``, from at most ``sample`` labelled documents.

    The sample is drawn by a hash of doc_id from one half of the hashes; ``held_out`` takes the
    other half, for measuring. Only hashed word counts of it come to the driver (2 kB a document,
    whatever its length). Without labelled documents there is none.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == (1 if held_out else 0)
    name = source_name(F.col("source"))
    label = F.when(name.isin(listed), name).when(name.isNotNull(), OTHER)
    labelled = documents.where(F.col("text").isNotNull() & name.isNotNull() & half).select("doc_id", "text", label.alias("s"))
    count = labelled.count()
    if not count:
        return None
    scale = 1 << 30
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, 0.95 * sample / count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), batch.column(2)], names=["doc_id", "bag", "s"])

    rows = drawn.mapInArrow(run, "doc_id bigint, bag binary, s string").orderBy("doc_id", "s").limit(sample).collect()
    bags = np.stack([np.frombuffer(r["bag"], np.float16) for r in rows]).astype(np.float32) if rows else None
    return SourceClassifier.train(bags, [r["s"] for r in rows]) if rows else None


def memberships(documents: DataFrame, targets: DataFrame, pattern: str = TOKEN_PATTERN, sample: int = SAMPLE) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """(doc_id, source, n_tokens, cap, p) and the targets as (source, share, max_repeats).

    ``p`` has one entry per target in the order of their names and a last one for ``OTHER``. It is the
    posterior of the classifier, times the probability of the document's label in each domain where it
    has a label (``LABEL_TRUST`` in its own). ``cap`` is how often the document may be used: what its
    source allows, or for an unknown source what its domains allow on average, at least once. Tokens
    and posteriors are made in one pass over the texts. Each doc_id counts once (of several rows the one
    with the most tokens); null ids are left out.
    """
    rows = targets.where("source is not null and target_share > 0").select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect()
    listed = sorted((r["s"], float(r["target_share"]), int(r["max_repeats"] or 1)) for r in rows)  # a small fixed table
    names = [t[0] for t in listed]
    model = train_classifier(documents, names, sample)
    domains = [*names, OTHER]
    place = {n: k for k, n in enumerate(domains)}
    caps = np.array([t[2] for t in listed] + [1], float)
    learned = [place[c] for c in model.classes] if model is not None else []
    count_tokens = re.compile(pattern).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, sources = part.column(1).to_pylist(), part.column(2).to_pylist()
                p = np.full((len(texts), len(domains)), 1.0 / len(domains))
                if model is not None:
                    p[:] = 0.0
                    p[:, learned] = model.posteriors(texts)
                told = [(i, place.get(x, place[OTHER])) for i, x in enumerate(sources) if x is not None]
                if told:
                    i, k = np.array(told).T
                    own = np.where(np.isin(k, learned), p[i, k], 1.0 / len(domains))
                    p[i] *= (1 - LABEL_TRUST) / max(1, len(domains) - 1)
                    p[i, k] = np.maximum(own, 1e-3) * LABEL_TRUST
                    p[i] /= p[i].sum(axis=1, keepdims=True)
                cap = np.maximum(1, np.floor(p @ caps + 1e-9))
                if told:
                    cap[i] = caps[k]
                tokens = [len(count_tokens(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tokens, pa.int64()), pa.array(cap.astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "source", "n_tokens", "cap", "p"])

    known = documents.where("doc_id is not null").select("doc_id", "text", source_name(F.col("source")).alias("source"))
    told = spread(known).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, cap int, p array<double>")
    once = told.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", "cap", "p")).alias("v"))
    return once.select("doc_id", "v.source", "v.n_tokens", "v.cap", "v.p"), listed


def reachable_targets(shares: np.ndarray, available: np.ndarray, budget: float) -> np.ndarray:
    """Tokens per source: shares of the budget, where a source that has too little gives what it has
    and the others take up the rest in proportion to their shares."""
    low, high = 0.0, 1e6
    for _ in range(200):
        k = (low + high) / 2
        low, high = (k, high) if np.minimum(available, k * shares * budget).sum() < budget else (low, k)
    return np.minimum(available, high * shares * budget)


@dataclass
class Fit:
    """The gradient steps (one row each), the starting rate, the target tokens and how far the fit is from them."""

    history: np.ndarray
    start: float
    goal: np.ndarray
    expected: np.ndarray
    residual: float  # the largest miss as a share of its target, or of 1 % of all target tokens if that is more
    converged: bool

    def rates(self, p: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Rates after all steps, each projected on 0..cap."""
        r = np.minimum(self.start, cap)
        for g in self.history:
            r = np.clip(r - p @ g, 0.0, cap)
        return r


def _columns(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, cap and n_tokens of a batch as arrays."""
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return p, batch.column("cap").to_numpy(zero_copy_only=False).astype(float), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)


def fit_rates(members: DataFrame, listed: list[tuple[str, float, int]], fraction: float, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Minimises the squared relative distance of the domains' expected tokens from their targets.

    Each step sums rate times tokens per domain over all documents, where they lie; only that vector
    (one number per domain) comes to the driver. A step is scaled by what a domain has, so domains of
    all sizes converge alike. Targets that the memberships cannot meet together leave a residual.
    """
    n = len(listed) + 1
    shares = np.array([t[1] for t in listed] + [0.0])
    fit = Fit(np.zeros((0, n)), float(fraction), shares, shares, 0.0, True)
    if n == 1:
        return fit
    rows = members.select("p", "cap", "n_tokens")

    def totals(kind: str) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    p, cap, tokens = _columns(batch, n)
                    rate = np.ones(len(p)) if kind == "have" else cap if kind == "most" else fit.rates(p, cap)
                    total += (rate * tokens) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["k", "t"])

        out = np.zeros(n)
        for r in rows.mapInArrow(run, "k bigint, t double").groupBy("k").agg(F.sum("t").alias("t")).collect():
            out[r["k"]] = r["t"]
        return out

    have = totals("have")
    fit.goal = reachable_targets(shares / max(shares.sum(), 1e-12), totals("most"), fraction * have.sum())
    before = np.full(n, np.inf)
    while True:
        fit.expected = totals("fit")
        fit.converged = bool(np.abs(fit.expected - before).max() <= tolerance * max(1.0, fit.goal.sum()))
        before = fit.expected
        miss = fit.expected - fit.goal
        fit.residual = float((np.abs(miss) / np.maximum(fit.goal, max(1.0, 0.01 * fit.goal.sum()))).max())
        if fit.converged or len(fit.history) >= steps:
            return fit
        fit.history = np.vstack([fit.history, np.where(have > 0, miss / np.maximum(have, 1.0), 0.0)])


def mixture(documents: DataFrame, targets: DataFrame, fraction: float, pattern: str = TOKEN_PATTERN, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the shares that came out.

    The first is (doc_id, source, repeats, n_tokens), with source the known one or the likeliest; a
    document is used at most ``max_repeats`` times. The second has, per target source: target_share,
    max_repeats, share (by the documents' own sources), expected_share (by their memberships), tokens,
    documents, available_tokens, and of the fit its steps, residual and whether it converged. Documents whose known source
    has no target, and those that most likely belong to none, are not chosen. Empty documents have no tokens and are not
    chosen. Sources without documents come out with share 0 and the others share their budget.
    Without targets nothing is chosen.
    """
    members, listed = memberships(documents, targets, pattern, sample)
    members = checkpointed(members)
    names, n = [t[0] for t in listed], len(listed) + 1
    fit = fit_rates(members, listed, fraction)
    place = {s: k for k, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, cap, _ = _columns(batch, n)
                likely = p.argmax(axis=1)
                domain = [place.get(s, n - 1) if s is not None else k for s, k in zip(batch.column("source").to_pylist(), likely.tolist(), strict=True)]
                told = pa.array([names[k] if k < n - 1 else None for k in domain], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), told, batch.column("n_tokens"), pa.array(fit.rates(p, cap)), pa.array(cap.astype(np.int64)), batch.column("bucket")],
                    names=["doc_id", "source", "n_tokens", "rate", "cap", "bucket"],
                )

    bucket = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(BUCKETS)).cast("int")
    usable = members.where("n_tokens > 0").select("doc_id", "source", "n_tokens", "cap", "p", bucket.alias("bucket"))
    rated = usable.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, rate double, cap bigint, bucket int").where("source is not null")
    # whole repeats: floor(rate), and once more below a limit of the hash; one row per source and bucket decides the limits
    sums = rated.groupBy("source", "bucket").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("want"), F.sum(F.floor("rate") * F.col("n_tokens")).alias("base"), F.sum(F.when(F.floor("rate") < F.col("cap"), F.col("n_tokens")).otherwise(0)).alias("extra")).collect()
    limits = []
    for s in names:
        table = np.zeros((BUCKETS, 3))
        for r in sums:
            if r["source"] == s:
                table[r["bucket"]] = r["want"], r["base"], r["extra"]
        reach = table[:, 1].sum() + np.concatenate([[0.0], np.cumsum(table[:, 2])])
        limits.append((s, int(np.abs(reach - table[:, 0].sum()).argmin())))
    limit = F.coalesce(*[F.when(F.col("source") == s, F.lit(b)) for s, b in limits], F.lit(0)) if limits else F.lit(0)
    more = (F.col("bucket") < limit) & (F.floor("rate") < F.col("cap"))
    repeats = (F.floor("rate") + more.cast("int")).cast("int")
    chosen = rated.select("doc_id", "source", repeats.alias("repeats"), "n_tokens").where("repeats > 0")
    return chosen, _shares(chosen, members, targets, names, fit)


def _shares(chosen: DataFrame, members: DataFrame, targets: DataFrame, names: list[str], fit: Fit) -> DataFrame:
    used = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"))
    have = members.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    total = chosen.agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("total"))
    listed = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    per = listed.join(used, "source", "left").join(have, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share")
    parts = fit.expected / max(1e-12, fit.expected.sum())
    expected = F.coalesce(*[F.when(F.col("source") == n, F.lit(round(float(x), 6))) for n, x in zip(names, parts, strict=False)], F.lit(0.0)).alias("expected_share")
    told = [F.lit(len(fit.history)).alias("steps"), F.lit(round(fit.residual, 6)).alias("residual"), F.lit(fit.converged).alias("converged")]
    return per.select("source", "target_share", "max_repeats", share, expected, zero("tokens"), zero("documents"), zero("available_tokens"), *told)
