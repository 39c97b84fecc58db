"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points, n-grams of 1 to 3 of them are hashed. The weights are learnt by
follow-the-regularised-leader steps with elastic-net penalties on a sample of the learning rows whose size is a parameter; a temperature
fitted on a part of the sample that the weights did not see calibrates the probabilities. Document frequencies come
from all learning rows. Term frequencies are relative, so a text's scores are the means of its n-grams' weights, and a
text of any length is scored in one pass without a feature vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

GRAMS, BITS = (1, 2, 3), 15
WIDTH = len(GRAMS) << BITS
CHUNKS = 16
#: Characters that are hashed together.
SLICE = 1 << 19


def features(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, features of the n-grams at up to 2 * SLICE places) for one or more joined texts, until all places had their turn."""
    for i, n in enumerate(GRAMS):
        for a in range(0, max(1, len(codes) - n + 1), 2 * SLICE):
            m = max(0, min(2 * SLICE, len(codes) - n + 1 - a))
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[a + k : a + k + m] + np.uint64(k + 1)
            yield n, (mix(h) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(i << BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # WIDTH x langs: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Predictions of whole texts; und with 0 for a text without a letter, or where nothing was learnt."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        i = 0
        while i < len(texts):
            j, parts, size = i, [], 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE):
                parts.append(_codes(texts[j] or ""))
                size += len(parts[-1])
                j += 1
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            total = np.tile(self.bias, (len(parts), 1))
            for n, at in features(np.concatenate(parts)):
                if len(parts) == 1:  # perhaps a part of a long text
                    total[0] += self.table[at].sum(axis=0) / max(len(parts[0]) - n + 1, 1)
                    continue
                sums = np.zeros((len(at) + 1, len(self.langs)))
                np.cumsum(self.table[at], axis=0, out=sums[1:])
                a, b = np.minimum(starts, len(at)), np.minimum(np.maximum(ends - n + 1, starts), len(at))
                total += (sums[b] - sums[a]) / np.maximum(b - a, 1)[:, None]
            p = softmax(total / self.temperature)
            best = p.argmax(axis=1)
            for k in range(len(parts)):
                if any(map(str.isalpha, texts[i + k] or "")):
                    langs[i + k], scores[i + k] = self.langs[best[k]], float(p[k, best[k]])
            i = j
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> chunk, blob: how many of the partition's texts have each feature, in CHUNKS parts."""
    total, seen, n = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, bool), 0
    for batch in batches:
        for text in batch.column(0):
            n += 1
            for _, at in features(_codes(text.as_py() or "")):
                seen[at] = True
            total += seen
            seen[:] = False
    parts = [x.tobytes() for x in np.split(total, CHUNKS)] + [np.array([n], np.int64).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS + 1), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])


def _add(table: pa.Table) -> pa.Table:
    return pa.table({"chunk": table.column("chunk").slice(0, 1).cast(pa.int32()), "counts": pa.array([sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")).tobytes()], pa.binary())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, lang, text) -> order, lang, and the relative frequencies of the text's features."""
    for batch in batches:
        rows = []
        for text in batch.column(2):
            count, codes = np.zeros(WIDTH, np.int64), _codes(text.as_py())
            for _, at in features(codes):
                count += np.bincount(at, minlength=WIDTH)
            at = np.flatnonzero(count).astype(np.int32)
            rows.append((at.tobytes(), (count[at] / np.maximum(len(codes) - (at >> BITS), 1)).astype(np.float32).tobytes()))
        at, tf = zip(*rows, strict=True) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], names=["place", "lang", "at", "tf"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], width: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width x classes, many of them 0) and biases. rows: (class, features, values)."""
    z, n = np.zeros((width, classes)), np.zeros((width, classes))
    bias, seen = np.zeros(classes), np.full(classes, 1e-8)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, at, x in rows:
            w = weights(at)
            error = softmax(x @ w + bias)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            seen += error * error
            bias -= 0.1 * error / np.sqrt(1 + seen)
    return weights(slice(None)), bias


#: Rows of a label in a sample, about, however rare it is.
FEWEST = 50


def in_sample(place: Column, label: Column, sample: int, counts: dict[str, int]) -> Column:
    """True for about `sample` of the rows, by a 64-bit hash of each, and for about FEWEST or all of a label's rows at
    least; for all if there are no more. counts: label -> rows."""
    total = sum(counts.values())
    if total <= sample:
        return F.lit(True)
    shares = [(F.lit(x), F.lit(int((1 << 40) * min(1.0, max(sample / total, FEWEST / n))))) for x, n in sorted(counts.items())]
    return F.pmod(place, F.lit(1 << 40)) < F.create_map(*(c for pair in shares for c in pair))[label]


def learn(rows: DataFrame, sample: int = 4000, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """A model from rows (id, lang, text) without nulls in lang. Weights and temperature are fitted on about `sample`
    rows, chosen by hashes of their ids, with FEWEST of each language; document frequencies count all rows."""
    counted = rows.select("text").mapInArrow(_frequencies, "chunk int, counts binary").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary")
    parts = {r["chunk"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}
    if not parts or not parts[CHUNKS][0]:
        return Model([], np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    total = int(parts[CHUNKS][0])
    idf = np.log((1 + total) / (1 + np.concatenate([parts[i] for i in range(CHUNKS)]))) + 1
    place = F.xxhash64(F.col("id").cast("string"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = rows.select(place.alias("place"), "lang", "text").where(in_sample(F.col("place"), F.col("lang"), sample, counts))
    kept = chosen.mapInArrow(_vectors, "place long, lang string, at binary, tf binary").collect()
    kept.sort(key=lambda r: (r["place"], r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in kept})
    data = []
    for r in kept:
        at = np.frombuffer(r["at"], np.int32)
        data.append((langs.index(r["lang"]), at, np.frombuffer(r["tf"], np.float32) * idf[at]))
    apart = data[::5] if len(data) >= 50 else []
    fit = [x for i, x in enumerate(data) if i % 5] if apart else data
    weights, bias = ftrl(fit, WIDTH, len(langs), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ weights[at] + bias for _, at, x in apart or data])
    truth = np.array([c for c, _, _ in apart or data])
    ladder = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in ladder]
    return Model(langs, weights * idf[:, None], bias, float(ladder[int(np.argmin(losses))]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row; und and 0 where the text is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 1, folds: int = 3) -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score.

    Rows whose crc32(id as text) mod folds is `fold` are held out: nothing is learnt from them. A null id is neither
    held out nor learnt from; null or empty texts and those without a letter are und; equal rows give equal rows; other
    columns are ignored; no rows give no rows.
    """
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    learning = docs.where((rest != fold) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = learn(learning.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    return identify(docs, model, id_col, text_col).select(id_col, held_out.alias("held_out"), "lang_pred", "score")
