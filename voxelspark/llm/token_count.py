"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced again.

A document over `chunk` characters is cut into windows that overlap. Every window is encoded on its own, and for each
place where its tokens may be spliced it reports the tokens before it. A place is proven stable when no piece of the
vocabulary can span it: a space after another character, in a vocabulary in which no piece has a space mark after
another character. Neighbouring windows are spliced at a stable place that both report; where they share none, the
document is encoded again with twice the overlap, and at last whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SPACE = "▁"


class Pieces:
    """A sentencepiece model or a tokenizers file, for counts and for stable places."""

    def __init__(self, path: str):
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            vocabulary = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
            self.splits_at_space = not any(SPACE in p.lstrip(SPACE) for p in vocabulary)
        else:
            from tokenizers import Tokenizer

            self.tokenizer, self.splits_at_space = Tokenizer.from_file(path), False
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.model is None:
            return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def places(self, text: str, first: bool) -> tuple[int, np.ndarray, np.ndarray]:
        """All tokens; offsets of stable places in text, and the tokens before each."""
        none = np.zeros(0, np.int64)
        if self.model is None or not self.splits_at_space:
            return self.counts([text])[0], none, none
        # The space before the window's first word is the one that the model puts before every text.
        pieces = self.model.encode(text, out_type=str)
        ends, at, pending = [], -1, 0
        for p in pieces:
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                byte = int(p[3:5], 16)
                if pending == 0:
                    pending = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                pending -= 1
                at += pending == 0
            else:
                at += len(p)
            ends.append(at)
        if at != len(text):  # the model has rewritten the text, so offsets prove nothing
            return len(pieces), none, none
        stable = np.array([i for i in range(1, len(text)) if text[i] == " " and text[i - 1] not in (" ", SPACE)], np.int64)
        before = np.searchsorted(np.array(ends), stable, side="right")
        return len(pieces), stable, before.astype(np.int64)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            n = pieces.counts([x or "" for x in batch.column(2).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def _windows(path: str, overlap: int):
    """Rows (key, k, last, start, text) -> key, k, last, n_tokens, and the stable places of the left and right overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n", "lp", "lc", "rp", "rc")}
            for k, start, last, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                n, at, before = pieces.places(text, k == 0)
                left, right = at < overlap, at >= len(text) - overlap
                for name, values in (("lp", at[left] + start), ("lc", before[left]), ("rp", at[right] + start), ("rc", before[right])):
                    cols[name].append(values.tolist() if not (name[0] == "r" and last) else [])
                cols["n"].append(n)
            lists = [pa.array(cols[c], pa.list_(pa.int64())) for c in ("lp", "lc", "rp", "rc")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cols["n"], pa.int64()), *lists], names=["key", "k", "last", "n", "lp", "lc", "rp", "rc"])

    return run


def spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """huge: (key, text) -> (key, n_tokens); n_tokens is null where neighbouring windows share no stable place."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(float(chunk)))).cast("int")
    cut = huge.select("key", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    cut = cut.select("key", "k", (F.col("k") * chunk).cast("long").alias("start"), (F.col("k") == F.col("n") - 1).alias("last"), F.when(F.col("k") == F.col("n") - 1, F.expr(f"substring(text, k * {chunk} + 1)")).otherwise(F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})")).alias("text"))
    seen = cut.repartition("key", "k").mapInArrow(_windows(path, overlap), "key string, k int, last boolean, n long, lp array<long>, lc array<long>, rp array<long>, rc array<long>")
    along = Window.partitionBy("key").orderBy("k")
    beside = seen.select("*", F.lead("lp").over(along).alias("next_p"), F.lead("lc").over(along).alias("next_c"))
    common = F.array_intersect("rp", "next_p")
    place = F.get(common, F.floor(F.size(common) / 2).cast("int"))
    at = lambda p, c: F.get(F.col(c), F.array_position(F.col(p), F.col("place")).cast("int") - 1)
    joint = beside.withColumn("place", F.when(~F.col("last"), place)).select(
        "key", "n", "last", F.when(F.col("place").isNotNull(), at("rp", "rc") - at("next_p", "next_c")).alias("shared")
    )
    # What window k has after the place, and window k + 1 before it, is counted twice.
    kept = F.when(F.col("last"), F.col("n")).otherwise(F.col("shared"))
    whole = joint.select("key", "last", "n", F.when(F.col("last"), F.lit(0)).otherwise(F.col("shared")).alias("joint"), kept.isNull().alias("lost"))
    return whole.groupBy("key").agg(F.when(~F.max("lost"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(F.lit(0)) + F.col("joint"))).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16_384, overlap: int = 256
) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit, without begin, end or added special tokens.

    A null text counts as the empty text. Equal rows give equal rows; null ids stay null; other columns are ignored; no
    rows give no rows. Texts over chunk + overlap characters are counted by windows, spread over the cluster.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    is_huge = F.length("text") > chunk + overlap
    counted = rows.where(~is_huge).mapInArrow(_count(path), f"id {kind}, n_bytes long, n_tokens long")

    huge = durable(rows.where(is_huge).withColumn("key", F.sha2(F.col("text").cast("binary"), 256)))
    open_, found = huge.groupBy("key").agg(F.first("text").alias("text")), None
    while True:
        round_ = durable(spliced(open_, path, max(chunk, 2 * overlap), overlap))
        done = round_.where(F.col("n_tokens").isNotNull())
        found = done if found is None else found.unionByName(done)
        lost = round_.where(F.col("n_tokens").isNull()).select("key")
        if lost.isEmpty():
            break
        overlap *= 2
        open_ = open_.join(lost, "key", "left_semi")
    long_ones = huge.select("id", "n_bytes", "key").join(found, "key").select("id", "n_bytes", "n_tokens")
    return counted.unionByName(long_ones).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
