"""Mixing documents to target domain weights with soft memberships.

A classifier learnt from a table of labels gives every document a posterior over the domains. Nonnegative rates, one a
document, are fitted by projected gradient least squares so that the expected domain tokens, sum of rate * tokens *
posterior, match the targets. Misses are weighed by the inverse of the second moments of the posteriors, so that rare
and similar domains do not slow the descent. Rates start at 1 and move only as far as the targets need. A rate is a
function of its document's posterior and of the few gradients so far, so an iteration is one pass that sums, and no
state is kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_batches
from .langid import ftrl, in_sample, softmax
from .shingles import LOWER, slices, words

BITS = 15
#: Labelled rows that the classifier is fitted on, about; chosen by hashes of their ids.
SAMPLE = 4000
#: Most iterations, and the distance from the targets, as a share of all tokens, at which they count as met.
ITERATIONS, CLOSE = 60, 1e-4


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # (1 << BITS) x domains
    bias: np.ndarray

    def posteriors(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (words) of each text, and its posteriors; null is the empty text."""
        n, p = np.zeros(len(text), np.int64), np.zeros((len(text), len(self.names)))
        for i, data, starts, ends in slices(text):
            h, of = words(LOWER[data], starts, ends)
            at = (h >> np.uint64(64 - BITS)).astype(np.int64)
            count = np.bincount(of, minlength=len(starts))
            sums = np.column_stack([np.bincount(of, weights=self.weights[at, d], minlength=len(starts)) for d in range(len(self.names))])
            n[i : i + len(starts)] = count
            p[i : i + len(starts)] = softmax(sums / np.sqrt(np.maximum(count, 1))[:, None] + self.bias)
        return n, p


@dataclass
class Rates:
    """Gradients so far (a step long); rates follow from posteriors by replaying them. goal and reached: domain tokens as a
    share of all tokens before the mix; lost: share of the targets' weights on domains that no label tells; close: whether
    goal and reached agree and nothing is lost."""

    gradients: list[np.ndarray] = field(default_factory=list)
    goal: np.ndarray = field(default_factory=lambda: np.ones(1))
    reached: np.ndarray = field(default_factory=lambda: np.ones(1))
    lost: float = 0.0
    close: bool = True

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and the extrapolated rates at which the next gradient is taken."""
        r = y = np.ones(len(p))
        for k, g in enumerate(self.gradients):
            new = np.maximum(0.0, y - p @ g)
            r, y = new, new + k / (k + 3) * (new - r)
        return r, y


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(2):
            ((_, data, starts, ends),) = list(slices(pa.array([text.as_py()], pa.string())))
            h, _ = words(LOWER[data], starts, ends)
            at, count = np.unique((h >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
            out.append((at.tobytes(), (count / np.sqrt(max(1, len(h)))).astype(np.float32).tobytes()))
        at, x = zip(*out, strict=True) if out else ([], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["place", "domain", "at", "x"])


def learn_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE) -> Domains:
    """A classifier from labels (id_col, domain_col), fitted on about `sample` of those with a document, FEWEST of each domain
    at least. Rows without a domain or a text are skipped; where nothing is left, there is one domain, `all`."""
    place = F.xxhash64(F.col(id_col).cast("string"))
    known = labels.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(domain_col).cast("string").alias("domain"), place.alias("place"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    known = durable(known.join(texts.select("__id").distinct(), "__id", "left_semi"))
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    chosen = known.where(in_sample(F.col("place"), F.col("domain"), sample, counts))
    rows = texts.join(F.broadcast(chosen), "__id").select("place", "domain", "text")
    kept = rows.mapInArrow(_features, "place long, domain string, at binary, x binary").collect()
    kept.sort(key=lambda r: (r["place"], r["domain"], r["at"]))
    names = sorted({r["domain"] for r in kept}) or ["all"]
    data = [(names.index(r["domain"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)) for r in kept]
    weights, bias = ftrl(data, 1 << BITS, len(names), epochs=10, alpha=1.0, beta=1.0, l1=0.02, l2=1e-4)
    return Domains(names, weights, bias)


def fit_rates(posteriors: DataFrame, names: list[str], targets: dict[str, float], anchor: str, growth: float) -> Rates:
    """posteriors: (n_tokens, p). targets: domain -> weight. The totals are such that the anchor's domain grows by growth.

    Targets that no nonnegative rates meet, or ITERATIONS passes do not, give a warning with what was reached, and close is
    False; so do weights of domains that no label tells, whose share is `lost`. The others keep their weights against the
    anchor's."""
    spark, d = posteriors.sparkSession, len(names)

    def passed(rates: Rates) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens; the second moments of p; expected domain tokens at the rates and at the extrapolated rates."""
        sent = spark.sparkContext.broadcast(rates)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d * d + 2 * d)
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                r, y = sent.value.replay(p)
                q = p * n[:, None]
                total += np.concatenate([[n.sum()], (q.T @ p).ravel(), q.T @ r, q.T @ y])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

        found = posteriors.select("n_tokens", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        sent.unpersist()
        x = np.zeros(1 + d * d + 2 * d)
        for r in found:
            x[r["i"]] = r["x"]
        return x[0], x[1 : 1 + d * d].reshape(d, d), x[1 + d * d : 1 + d * d + d], x[1 + d * d + d :]

    rates = Rates()
    total, moments, at, ahead = passed(rates)
    wanted = np.array([targets.get(x, 0.0) for x in names])
    unknown = {x: w for x, w in targets.items() if w > 0 and x not in names}
    if unknown:
        rates.lost, rates.close = sum(unknown.values()) / sum(w for w in targets.values() if w > 0), False
        warnings.warn(f"mixing: no label tells {sorted(unknown)}, {rates.lost:.4g} of the targets' weights are lost", stacklevel=2)
    if not total or d == 1 or not wanted.sum():
        rates.goal = rates.reached = at / max(total, 1.0)
        return rates
    wanted = wanted / wanted.sum()
    base = names.index(anchor) if anchor in names else int(at.argmax())
    goal = wanted * (growth * at[base] / wanted[base] / total if wanted[base] else growth)
    weigh = np.linalg.pinv(moments / total, rcond=1e-9, hermitian=True)  # the step that fits exactly where no rate is cut off at 0
    met = lambda: np.abs(at / total - goal).max() <= CLOSE * goal.sum()
    while not met() and len(rates.gradients) < ITERATIONS:
        rates.gradients.append(weigh @ (ahead / total - goal))
        _, _, at, ahead = passed(rates)
    rates.goal, rates.reached, rates.close = goal, at / total, bool(met()) and not unknown
    if not met():
        warnings.warn(f"mixing: wanted {dict(zip(names, goal.tolist(), strict=True))}, reached {rates.reached.tolist()}", stacklevel=2)
    return rates


def measured_by(domains: Domains, docs: DataFrame, text_col: str) -> Column:
    """The struct (n_tokens, p) of each row's text, the only column that goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(domains)  # 2 ** BITS weights a domain

    @F.arrow_udf("struct<n_tokens: long, p: array<double>>")
    def of(text: pa.Array) -> pa.Array:
        n, p = sent.value.posteriors(text)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(n), lists], names=["n_tokens", "p"])

    return of(F.col(f"`{text_col}`").cast("string"))


def measure(docs: DataFrame, domains: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, p) of each row."""
    return docs.select(F.col(id_col), measured_by(domains, docs, text_col).alias("m")).select(id_col, "m.n_tokens", "m.p")


def _copies(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Whole copies whose mean is the rate; draw: uniform in [0, 1)."""
    return np.floor(rate + draw).astype(np.int64)


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str, growth: float = 1.1, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """One row per input row: id_col, n_tokens, domain (the likeliest), p_domain, rate, copies, and for that domain the
    expected tokens wanted and reached, as a share of all tokens before the mix; lost is the share of the targets' weights
    on domains that no label tells, the same in every row.

    A null text has no tokens. Equal rows get equal rates; null ids stay null; other columns are ignored; no rows give
    no rows. copies is the rate rounded up or down by a hash of the id, so that its mean is the rate.
    """
    domains = learn_domains(docs, labels, id_col, text_col, domain_col)
    with text_batches(docs.sparkSession):
        measured = durable(measure(docs, domains, id_col, text_col))
    rates = fit_rates(measured, domains.names, targets, anchor, growth)
    sent = docs.sparkSession.sparkContext.broadcast((domains.names, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fitted = sent.value
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            r, _ = fitted.replay(p)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            copies = _copies(r, batch.column(3).to_numpy(zero_copy_only=False))
            domain = [pa.array([names[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best])]
            totals = [pa.array(np.broadcast_to(x, len(names))[best].astype(float)) for x in (fitted.goal, fitted.reached, np.float64(fitted.lost))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *domain, pa.array(r), pa.array(copies), *totals], names=["id", "n_tokens", "domain", "p_domain", "rate", "copies", "wanted", "reached", "lost"])

    kind = docs.schema[id_col].dataType.simpleString()
    drawn = measured.select(F.col(id_col).alias("id"), "n_tokens", "p", draw(id_col).alias("draw"))
    schema = f"id {kind}, n_tokens long, domain string, p_domain double, rate double, copies long, wanted double, reached double, lost double"
    return drawn.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def draw(id_col: str):
    """Uniform in [0, 1), by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str, growth: float = 1.1, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """docs with every row as often as its copies say, and its columns as they were.

    Rows of rate under 1 may go, rows of a larger rate may come more than once; rows that repeat an id have the same
    draw. Null texts have the posterior of the empty text; null ids share one draw; no rows give no rows. Where the targets
    are not met, or no label tells a domain, the nearest rates are used all the same, with a warning; mix_rates returns
    what was wanted, reached and lost. The posteriors are written beside the rows once, so texts are neither shuffled nor
    sent to Python again.
    """
    domains = learn_domains(docs, labels, id_col, text_col, domain_col)
    m, n = (next(f"{x}{i}" for i in range(len(docs.columns) + 1) if f"{x}{i}" not in docs.columns) for x in ("__m", "__n"))
    with text_batches(docs.sparkSession):
        rows = durable(docs.withColumn(m, measured_by(domains, docs, text_col)))
    rates = fit_rates(rows.select(f"{m}.n_tokens", f"{m}.p"), domains.names, targets, anchor, growth)
    sent = docs.sparkSession.sparkContext.broadcast(rates)

    @F.arrow_udf("long")
    def copies(p: pa.Array, drawn: pa.Array) -> pa.Array:
        posteriors = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
        return pa.array(_copies(sent.value.replay(posteriors)[0], drawn.to_numpy(zero_copy_only=False)))

    again = rows.withColumn(n, copies(F.col(f"{m}.p"), draw(id_col)))
    return again.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).drop(m, n)
