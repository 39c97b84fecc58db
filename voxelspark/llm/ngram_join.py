"""Jaccard self-join of documents on word n-grams by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments; every document's set falls into
segments, one a fragment; a fragment counts the overlaps of the segments it holds; the partial overlaps are summed.

1. Documents with one set make one class, whose node in the graph of links is a 64-bit digest of the set.
2. Peeling. Each fragment counts, for each node, the n-grams that another set has too. Summed over the fragments this
   bounds the overlap with any other set, so a node below the threshold has no link. Nearly all go. What a part of the
   texts shows by itself is counted there: of an n-gram with many documents in it, two go on, which tell the fragment
   that it is shared. So a very frequent n-gram reaches its fragment with two entries a part, not one a document.
3. What is left goes to bands of set sizes (a set also to the next band if a partner may be there), and each band is cut
   into as many fragments as its n-grams need to fit tasks. So segments stay long, a pair has partial overlaps in the
   fragments of one band only, and what a task counts does not grow with all of the table.
4. Near pass. Fragments list the nodes of each n-gram in one common order (set size, then a hash of the node) and
   count overlaps between nodes at most `window` places apart. Two nodes that are `window` apart in that order are as
   near in every list that holds both, so their sums are exact; other sums are lower bounds, so every link found is
   one. This costs a list of any length linear work and links most members of large groups.
5. Far pass, for nodes with an n-gram whose list is longer than that. A similarity join within each fragment of a band
   (sieve.py) finds the links of a band of one fragment, else clusters that hold every link. Clusters that fit a task are
   joined whole; of larger ones, partial overlaps are counted and summed again. Nodes of one component are not compared.

A pair's partial overlap is dropped if its segments differ by more than two similar sets may differ as a whole.
Pairs travel packed in arrays, by a hash of the pair; sums leave a spanning forest of their links, not all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .common import by_bytes, durable, forget, text_batches, tidy, tidy_group, without
from .components import components
from .shingles import mix, shingle_sets, sums

#: N-grams that a fragment holds on average, in the peeling and of a band of what it leaves; more memory a task allows for
#: more. A pair has a partial overlap in each fragment that it shares n-grams in, so few fragments mean less to send.
FRAGMENT, FRAGMENT_LEFT = 1_500_000, 1_000_000
#: Bytes of text whose n-grams are compared before they are sent.
PART = 1 << 22
#: Survivors (16 bytes each) up to which their table is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 500_000
#: Codes of pairs that are merged together, and entries of n-grams' lists that are gone through together.
MERGE, STRETCH = 500_000, 200_000
#: Pairs that are counted before they are sent.
COUNTED = 4_000_000
#: Pairs whose partial overlaps are sent together, and summed in a task.
SENT, SUMMED = 500_000, 4_000_000


def _digests(sizes: np.ndarray, keys: np.ndarray, c: int = 0x5851F42D4C957F2D) -> np.ndarray:
    return sums(mix(keys ^ np.uint64(c)), sizes).view(np.int64)


def _sets(width: int):
    """(id, text) -> id, n, d1, d2: the size and a 128-bit digest of the set. d1 is the set's node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, PART):
                sizes, keys = shingle_sets(part.column(1), width)
                digests = [_digests(sizes, keys), _digests(sizes, keys, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *map(pa.array, digests)], names=["id", "n", "d1", "d2"])

    return run


def _fragment(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n <= 65_535 else np.uint32)


def _blobs(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _read(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]


PEEL = pa.schema([("fragment", pa.int32()), ("part", pa.int64()), ("nodes", pa.binary()), ("local", pa.binary()), ("keys", pa.binary())])
SHARED = pa.schema([("part", pa.int64()), ("nodes", pa.binary()), ("local", pa.binary()), ("shared", pa.binary())])


def _cut(width: int, n: int):
    """(text) -> for each part of the texts and fragment: the n-grams, the number within the part of each one's node,
    and these nodes; and, with a fragment below 0, the part's nodes and what it knows of their shared n-grams.

    Of equal sets in a part one stands for all. The fragment has the high bits of an n-gram, so 32 further bits are kept;
    a rare collision of n-grams only peels less. Nodes are sent whole, as two that were taken for one would seem to
    share nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task << 32
        for part in (p for batch in batches for p in by_bytes(batch, 0, PART)):
            sizes, keys = shingle_sets(part.column(0), width)
            nodes = _digests(sizes, keys)
            kept = np.zeros(len(sizes), bool)
            kept[np.unique(nodes, return_index=True)[1]] = True
            kept &= sizes > 0
            keys, nodes, sizes = keys[np.repeat(kept, sizes)], nodes[kept], sizes[kept]
            of = np.repeat(np.arange(len(nodes), dtype=np.uint16), sizes)  # a batch has at most TEXTS rows
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            more = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys)))) >= 2
            shared = np.bincount(of[more], minlength=len(nodes)).astype(np.uint32)
            rows = [(-1 - (task + number) % n, number, nodes, b"", shared)]
            keys, of = keys[~more], of[~more]
            fragment, low = _fragment(keys, n).astype(np.int64), keys.astype(np.uint32)
            edges = np.append(np.flatnonzero(np.diff(fragment, prepend=-1)), len(keys)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                order = a + np.argsort(of[a:b], kind="stable")
                rows.append((int(fragment[a]), number, nodes[np.unique(of[a:b])], of[order], low[order]))
            yield from _blobs(rows, PEEL).to_batches()
            number += 1

    return run


def _peel(table: pa.Table) -> pa.Table:
    """For each part, how many n-grams of its nodes another set has too; the rows of fragments below 0 go on as they are."""
    parts = table.column("part").to_pylist()
    if table.column("fragment")[0].as_py() < 0:
        return _blobs([(p, n.as_py(), b"", c.as_py()) for p, n, c in zip(parts, table.column("nodes"), table.column("keys"), strict=True)], SHARED)
    local, kinds = _read(table, "local", np.uint16), _read(table, "nodes", np.int64)
    places = [np.cumsum(np.diff(x, prepend=x[:1]) > 0) for x in local]  # of each n-gram's node among those of its part and fragment
    sizes, starts = [len(k) for k in kinds], np.cumsum([0] + [len(k) for k in kinds])
    of = np.concatenate([p.astype(np.int32) + np.int32(s) for p, s in zip(places, starts, strict=False)])
    keys, kind = np.concatenate(_read(table, "keys", np.uint32)), np.unique(np.concatenate(kinds), return_inverse=True)[1].astype(np.int32)
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    own = kind[of]
    shared = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    count = np.bincount(of[np.repeat(shared, np.diff(np.r_[start, len(keys)]))], minlength=len(kind)).astype(np.uint32)
    rows = []
    for part, x, a, n in zip(parts, local, starts, sizes, strict=False):
        c = count[a : a + n]
        rows.append((part, b"", np.unique(x)[c > 0], c[c > 0]))
    return _blobs(rows, SHARED)


def _sum_shared(table: pa.Table) -> pa.Table:
    """A part's rows -> (node, shared)."""
    nodes, total = np.zeros(0, np.int64), np.zeros(1 << 16, np.int64)
    for n, x, c in zip(_read(table, "nodes", np.int64), _read(table, "local", np.uint16), _read(table, "shared", np.uint32), strict=True):
        if len(n):
            nodes, x = n, np.arange(len(n))
        total[x] += c
    return pa.table({"node": nodes, "shared": total[: len(nodes)]})


SEGMENTS = pa.schema([("fragment", pa.int32()), ("ids", pa.binary()), ("ns", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])
BANDED = pa.schema([("key", pa.int64()), ("parts", pa.int64()), *SEGMENTS])


def _cut_sets(part: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """part: (node, label, key, parts, text). Its rows without texts of another node, which share an id with one; set sizes,
    n-grams, row of each, and the fragment of each among the row's `parts`."""
    sizes, keys = shingle_sets(part.column(4), width)
    asked = _digests(sizes, keys) == part.column(0).to_numpy(zero_copy_only=False)
    keys, sizes, part = keys[np.repeat(asked, sizes)], sizes[asked], part.filter(pa.array(asked))
    of, parts = np.repeat(np.arange(len(sizes)), sizes), part.column(3).to_numpy(zero_copy_only=False)
    return part, sizes, keys, of, (((keys >> np.uint64(32)) * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _segments(width: int):
    """(node, label, key, parts, text) -> for each part of the texts, key and fragment: nodes, set sizes, segment sizes, and
    the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, 4, PART)):
            part, sizes, keys, of, fragment = _cut_sets(part, width)
            nodes, key, parts = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            order = np.lexsort((fragment, key[of]))  # stable, so documents stay together
            of, keys, fragment = of[order], keys[order], fragment[order]
            new = np.r_[True, (key[of[1:]] != key[of[:-1]]) | (fragment[1:] != fragment[:-1])][: len(of)]
            edges, rows = np.append(np.flatnonzero(new), len(keys)).tolist(), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                begin = np.flatnonzero(np.diff(of[a:b], prepend=-1))
                docs = of[a:b][begin]
                group = (int(key[of[a]]), int(parts[of[a]]), int(fragment[a]))
                rows.append((*group, nodes[docs], sizes[docs], np.diff(np.append(begin, b - a)), keys[a:b]))
            yield from _blobs(rows, BANDED).to_batches()

    return run


def _in_groups(width: int):
    """(node, label, key, parts, text) -> a row for each segment of the text's set: key, parts, fragment, id, n, label, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in by_bytes(batch, 4, PART)):
            part, sizes, keys, of, fragment = _cut_sets(part, width)
            begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (fragment[1:] != fragment[:-1])][: len(of)])  # n-grams rise
            ends, row = (np.append(begin, len(keys)) * 8).astype(np.int32), pa.array(of[begin])
            segments = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])
            node, label, key, number = (part.column(k).take(row) for k in range(4))
            columns = [key, number, pa.array(fragment[begin].astype(np.int32)), node, pa.array(sizes[of[begin]]), label, segments]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "parts", "fragment", "id", "n", "label", "keys"])

    return run


PAIRS = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("overlap", pa.binary()), ("total", pa.binary())])


class _Counts:
    """Counts of codes that are added in parts."""

    def __init__(self) -> None:
        self.codes, self.counts, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size > MERGE:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        at = np.searchsorted(self.codes, new)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == new[known]
        self.counts[at[known]] += n[known].astype(np.uint32)
        at, new, n = at[~known], new[~known], n[~known].astype(np.uint32)
        self.codes, self.counts = np.insert(self.codes, at, new), np.insert(self.counts, at, n)
        self.waiting, self.size = [], 0


def _packed(buckets: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, total: np.ndarray) -> list[tuple]:
    """Rows of PAIRS."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    bucket = (mix(mix(a.view(np.uint64)) + b.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
    cols = (a, b, n.astype(np.uint32), total.astype(np.uint32))
    return [(int(bucket[order[i]]), *(c[order[i:j]].tobytes() for c in cols)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _may(percent: int, own: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of sizes `total` together may be linked, with segments of sizes `own` together that share n."""
    return (100 + percent) * (own - 2 * n) <= (100 - percent) * total


def _overlaps(percent: int, buckets: int, window: int | None):
    """The partial overlaps of a fragment in one table: near ones, or without a window all."""
    count = _far_overlaps(percent, buckets) if window is None else _near_overlaps(percent, buckets, window)
    return lambda table: pa.Table.from_batches(list(count(iter(table.to_batches()))), PAIRS)


def _near_overlaps(percent: int, buckets: int, window: int, edges: list[int] | None = None):
    """A fragment's segments -> partial overlaps of pairs, and (as pairs of an id with itself) the ids in lists longer than
    the window. Rows of nodes are gone through by about COUNTED pairs. edges: where bands begin; a pair whose larger set is
    below its band counts in the band before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        least = edges[table.column("key")[0].as_py()] if edges else 0
        ids, sizes, own = (np.concatenate(_read(table, c, np.int64)) for c in ("ids", "ns", "sizes"))
        keys = np.concatenate(_read(table, "keys", np.uint64))
        del table
        # In the common order, each node once.
        rank = np.lexsort((ids, mix(ids.view(np.uint64)), sizes))
        rank = rank[np.diff(ids[rank], prepend=~ids[rank][:1]) != 0]
        place = np.full(len(ids), -1, np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        of = np.repeat(place, own)
        keys, of = keys[of >= 0], of[of >= 0]
        ids, sizes, own = ids[rank], sizes[rank], own[rank]
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.append(starts, len(keys)))
        past = np.repeat((starts + length).astype(np.int32), length)
        far = ids[np.unique(of[np.repeat(length > window + 1, length)])]
        del order, place, keys, starts, length
        for first in range(0, len(ids), some := max(1, COUNTED // window)):
            counts, here = _Counts(), np.flatnonzero((of >= first) & (of < first + some))
            for k in range(0, len(here), STRETCH):
                at = here[k : k + STRETCH]
                end = past[at]
                for step in range(1, window + 1):
                    inside = at + step < end
                    at, end = at[inside], end[inside]
                    if not len(at):
                        break
                    i, j = of[at], of[at + step]  # i comes first in the order
                    near = (100 * sizes[i] >= percent * sizes[j]) & (sizes[j] >= least)
                    counts.add((i[near].astype(np.uint64) << np.uint64(32)) | j[near].astype(np.uint64))
            counts.merge()
            for k in range(0, len(counts.codes), SENT):
                codes, n = counts.codes[k : k + SENT], counts.counts[k : k + SENT].astype(np.int64)
                i, j = (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
                total = sizes[i] + sizes[j]
                may = _may(percent, own[i] + own[j], n, total)
                yield from _blobs(_packed(buckets, ids[i[may]], ids[j[may]], n[may], total[may]), PAIRS).to_batches()
        yield from _blobs(_packed(buckets, far, far, np.zeros(len(far)), np.ones(len(far))), PAIRS).to_batches()

    return run


def _far_overlaps(percent: int, buckets: int):
    """Segments (id, n, label, keys) of a fragment -> partial overlaps of all pairs of different labels, by blocks of rows: no
    more than about SENT pairs, or those of a block, wait to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own, keys = sieve.grams(table.column("keys"))
        s = sieve.read(table.column("id").to_numpy(), own, table.column("label").to_numpy(), keys, percent, table.column("n").to_numpy())
        del own, keys, table
        held, waiting = [], 0
        for a, b, n in sieve.overlapping(s, percent, len(s.own), True):
            total = s.size[a] + s.size[b]
            may = _may(percent, s.own[a] + s.own[b], n, total)
            held.append((s.ids[a[may]], s.ids[b[may]], n[may], total[may]))
            waiting += len(held[-1][0])
            if waiting >= SENT:
                yield from _blobs(_packed(buckets, *map(np.concatenate, zip(*held, strict=True))), PAIRS).to_batches()
                held, waiting = [], 0
        if waiting:
            yield from _blobs(_packed(buckets, *map(np.concatenate, zip(*held, strict=True))), PAIRS).to_batches()

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees when they are added in order."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _sum_overlaps(percent: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = np.concatenate(_read(table, "a", np.int64)), np.concatenate(_read(table, "b", np.int64))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[start], b[start]
        n = np.add.reduceat(np.concatenate(_read(table, "overlap", np.uint32))[order], start, dtype=np.int64)
        total = np.concatenate(_read(table, "total", np.uint32))[order[start]].astype(np.int64)
        link = (100 + percent) * n >= percent * total
        tree, far = _forest(a[link], b[link]), a[a == b].tolist()
        return pa.table({"a": pa.array([x for x, _ in tree] + far, pa.int64()), "b": pa.array([y for _, y in tree] + far, pa.int64())})

    return run


def _edges(percent: int, most: int) -> list[int]:
    """Sizes that bands begin with: two sets that may be linked are of one band, or of neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-3 * out[-1] // 2), -(-100 * out[-1] // percent)))
    return out


SETS = "key long, parts long, fragment int, id long, n long, label long, keys binary"
PAIRS_DDL, LINKS = "bucket int, a binary, b binary, overlap binary, total binary", "a long, b long"


def _banded(texts: DataFrame, sets: DataFrame, edges: list[int], percent: int) -> tuple[DataFrame, int]:
    """texts: (node, n, label, text), of the sets, as (node, label, key, parts, text) with a row for each band of a set; and the
    sets of each band times its fragments, summed."""
    starts = F.array(*map(F.lit, edges))
    band = F.size(F.filter(starts, lambda e: e <= F.col("n"))) - 1
    bands = F.explode(F.when(100 * F.col("n") >= percent * F.get(starts, band + 1), F.array(band, band + 1)).otherwise(F.array(band))).alias("key")
    held = sets.select("n", bands).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")).collect()  # some dozens
    parts = {r["key"]: -(-r["n"] // FRAGMENT_LEFT) for r in held}
    number = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))[F.col("key")] if parts else F.lit(1)
    return texts.select("*", bands).select("node", "label", F.col("key").cast("long"), number.cast("long").alias("parts"), "text"), sum(r["sets"] * parts[r["key"]] for r in held)


def _buckets(pairs: float) -> int:
    return min(10_000, max(8, -int(-pairs // SUMMED)))


def _sifted(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(parts, a, b): what the similarity joins of the groups find, which are links where parts is 1."""

    def slices(table: pa.Table) -> pa.Table:
        out = sieve.sift_slice(percent)(table)
        return out.add_column(0, "parts", pa.array([table.column("parts")[0].as_py()] * out.num_rows, pa.int64()))

    found = rows.mapInArrow(tidy(_in_groups(width)), SETS).groupBy("key", "fragment").applyInArrow(tidy(sieve.sift_groups(percent)), sieve.GROUPS_DDL)
    found = durable(found)
    sliced = found.where("slice >= 0").groupBy("parts", "key", "fragment", "slice").applyInArrow(tidy_group(slices), "parts long, a long, b long")
    both = durable(found.where("slice < 0").select("parts", "a", "b").unionByName(sliced))
    forget(found)
    return both


def _far_links(texts: DataFrame, asked: DataFrame, edges: list[int], width: int, percent: int) -> DataFrame:
    """texts: (node, n, text); asked: (node, n, label) -> (a, b): links of nodes or labels that join the labels whose nodes are
    linked."""
    few = asked.count() <= BROADCAST_ROWS
    texts = durable(texts.join(F.broadcast(asked.select("node", "label")) if few else asked.select("node", "label"), "node"))
    found = _sifted(_banded(texts, asked, edges, percent)[0], width, percent)
    out = found.where("parts = 1").select("a", "b")
    maybe = components(found.where("parts > 1")).select(F.col("id").alias("label"), F.col("component").alias("cluster"))
    grams = asked.join(maybe, "label").groupBy("cluster").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("ids"))
    clusters = durable(grams.withColumn("parts", F.ceil(F.col("grams") / FRAGMENT_LEFT)))
    whole, pairs = clusters.agg(F.sum(F.when(F.col("parts") == 1, F.col("grams"))), F.sum(F.when(F.col("parts") > 1, F.col("ids") * F.col("ids") / 2 * F.col("parts")))).first()
    several = texts.join(maybe, "label").join(clusters, "cluster")
    columns = lambda key: ("node", "label", key.cast("long").alias("key"), F.col("parts").cast("long").alias("parts"), "text")
    if whole:
        bins = F.pmod(F.xxhash64("cluster"), F.lit(-(-2 * whole // FRAGMENT_LEFT)))
        out = out.unionByName(_sifted(several.where("parts = 1").select(*columns(bins)), width, percent).select("a", "b"))
    if pairs:
        cut = several.where("parts > 1").select(*columns(F.col("cluster"))).mapInArrow(tidy(_in_groups(width)), SETS)
        counted = cut.groupBy("key", "fragment").applyInArrow(tidy(_far_overlaps(percent, _buckets(pairs))), PAIRS_DDL)
        out = out.unionByName(durable(counted.groupBy("bucket").applyInArrow(tidy_group(_sum_overlaps(percent)), LINKS)))
    forget(texts)
    return out


def ngram_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", window: int = 32
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Two documents are linked when 100 * overlap >= percent * union of their sets of distinct `width`-word shingles. A
    null text, or one without words, has the empty set and no link. Every row is a document of its own: rows that share
    an id are linked by their texts only, and rows that repeat id and text have equal results. Null ids have no links
    and a null component. Ids are integers. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where(F.col("id").isNotNull())
    with text_batches(spark):
        sets = durable(texts.mapInArrow(tidy(_sets(width)), "id long, n long, d1 long, d2 long"))
    n_grams = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digest = ["n", "d1", "d2"]
    classes = durable(sets.where("n > 0 and id is not null").groupBy(*digest).agg(F.min("id").alias("first")))

    fragments = max(8, -(-n_grams // FRAGMENT))
    with text_batches(spark):
        cut = known.select("text").mapInArrow(tidy(_cut(width, fragments)), "fragment int, part long, nodes binary, local binary, keys binary")
        counted = cut.groupBy("fragment").applyInArrow(tidy_group(_peel), "part long, nodes binary, local binary, shared binary")
        shared = counted.groupBy("part").applyInArrow(tidy_group(_sum_shared), "node long, shared long").groupBy("node").agg(F.max("shared").alias("shared"))
        left = durable(classes.join(shared, classes["d1"] == shared["node"]).where(F.col("shared") * 100 >= F.col("n") * percent).select("node", "n", "first"))
    n_left, most = left.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()

    edges = _edges(percent, most)
    survivors = left.select("node", "n", F.col("first").alias("id"))
    survivors = F.broadcast(survivors) if n_left <= BROADCAST_ROWS else survivors
    with text_batches(spark):
        texts = durable(known.join(survivors, "id").select("node", "n", "text"))
        banded, counts = _banded(texts.withColumn("label", F.col("node")), left, edges, percent)
        segments = banded.mapInArrow(tidy(_segments(width)), "key long, parts long, fragment int, ids binary, ns binary, sizes binary, keys binary")
        pairs = segments.groupBy("key", "fragment").applyInArrow(tidy(_near_overlaps(percent, _buckets(counts * window), window, edges)), PAIRS_DDL)
        near = durable(pairs.groupBy("bucket").applyInArrow(tidy_group(_sum_overlaps(percent)), LINKS))
        found, far = near.where("a <> b"), near.where("a = b").select(F.col("a").alias("node")).distinct()
        reached = components(found)
        if not far.isEmpty():
            asked = far.join(left, "node").join(reached.withColumnRenamed("id", "node"), "node", "left")
            asked = durable(asked.select("node", "n", F.coalesce("component", "node").alias("label")))
            more = durable(_far_links(texts, asked, edges, width, percent))
            if not more.isEmpty():
                known_links = reached.select(F.col("id").alias("a"), F.col("component").alias("b"))
                reached = components(known_links.unionByName(more))
    forget(texts, near)

    linked = durable(classes.join(reached.withColumnRenamed("id", "d1"), "d1").select(*digest, "first", "component"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("found"))
    of_class = linked.join(smallest, "component").select(*digest, "found")
    single = classes.join(of_class, digest, "left").select(*digest, F.coalesce("found", "first").alias("found"))
    own = sets.join(single, digest, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of linked documents, but for the one with the smallest id of each component, with all columns.

    Rows go by id: of rows that share an id, all stay if one of them is its component's smallest. Rows with a null id,
    a null or an empty text stay. No rows give no rows.
    """
    found = ngram_components(docs, width, percent, id_col, text_col)
    judged = found.groupBy(id_col).agg(F.min(F.col("component_id") != F.col(id_col)).alias("gone"))
    return without(docs, judged.where("gone").select(id_col), id_col)
