"""Which documents of long lists may be linked: a similarity join within each fragment of the n-gram order.

If two sets have a Jaccard similarity of at least t, so have their segments in one fragment at least: were each
fragment's overlap below t times its union, so would be their sums. So each fragment joins its own segments at t, and
every link is within a connected group of what the fragments find. Their partial overlaps then have to be counted only
within such groups, of which documents that merely share passages have none. With one fragment, what is found are the
links.

In a fragment, n-grams that the same documents have are one token with a weight. Tokens are ordered by the number of
their documents. A segment of s n-grams may miss (100 - percent) * s / 100 of them at most, so tokens that come after
that weight need not be looked at to find its partners (prefix), which have s * 100 / percent n-grams at most (length).
Overlaps come from all tokens of a row at once where that is less work than looking partners up one by one. A fragment
with much work is cut by rows into slices, which are tasks of their own and leave the task one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import mix

#: Pairs that are gone through together, and the work (about pairs of a token) of a slice.
BLOCK, SLICE_WORK = 1_000_000, 50_000_000
#: Slices of a fragment at most; beyond, they are larger.
SLICES = 32
#: What a looked-up token of a pair costs, in pairs that are counted from lists.
LOOK_UP = 8

ARRAYS = {"own": np.int64, "label": np.int32, "names": np.int64, "count": np.int64, "token": np.int32, "prefix": np.bool_, "weight": np.int64}
SCHEMA = pa.schema(
    [("fragment", pa.int32()), ("slice", pa.int32()), ("rows", pa.int64()), ("direct", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())]
    + [(name, pa.binary()) for name in ARRAYS]
)
DDL = "fragment int, slice int, rows long, direct boolean, a long, b long, " + ", ".join(f"{name} binary" for name in ARRAYS)


class Segments:
    """Distinct segments of a fragment in the order of their sizes: own (sizes), label (numbers of names); and, segment by
    segment, count tokens each, with their numbers in the common order, weights, and whether they are of its prefix. size
    and ids, where they are asked for: the sizes of the whole sets, whose order it is then, and the ids."""

    def __init__(self, size: np.ndarray | None = None, ids: np.ndarray | None = None, **arrays: np.ndarray) -> None:
        self.own, self.label, self.names, self.count, self.token, self.prefix, self.weight = (arrays[k] for k in ARRAYS)
        self.row = np.repeat(np.arange(len(self.own)), self.count)
        self.size, self.ids = self.own if size is None else size, ids

    def lists(self, percent: int, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens (of prefixes): the rows token by token; and of each, row by row, its row, the place after it in
        these lists, and how many rows follow there that are not too large."""
        take = np.flatnonzero(self.prefix) if prefix else np.arange(len(self.row))
        row, n = self.row[take], len(self.own) + 1
        code = self.token[take].astype(np.int64) * n + row
        order = np.argsort(code, kind="stable")
        last = np.searchsorted(self.size, 100 * self.size // percent, side="right")
        place = np.empty(len(take), np.int64)
        place[order] = np.arange(1, len(take) + 1)
        follow = np.searchsorted(code[order], code - row + last[row]) - place
        return take, row[order], place, follow


def grams(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of n-grams of a column of segments, and these."""
    own, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for chunk in column.cast(pa.binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        own.append(np.diff(ends) // 8)
        keys.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64))
    return np.concatenate(own), np.concatenate(keys)


def read(ids: np.ndarray, own: np.ndarray, label: np.ndarray, keys: np.ndarray, percent: int, size: np.ndarray | None = None) -> Segments:
    """The segments of the ids (each once), without tokens that no two labels have."""
    names, label = np.unique(label, return_inverse=True)
    rank = np.lexsort((ids, mix(ids.view(np.uint64)), own if size is None else size))
    rank = rank[np.diff(ids[rank], prepend=~ids[rank][:1]) != 0]
    place = np.full(len(ids), -1, np.int64)
    place[rank] = np.arange(len(rank))
    row = np.repeat(place, own)
    keys, row = keys[row >= 0], row[row >= 0]
    own, label, ids, size = own[rank], label[rank].astype(np.int32), ids[rank], None if size is None else size[rank]
    order = np.lexsort((row, keys))
    keys, row = keys[order], row[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(keys)))
    # Lists are compared by 128 bits of their rows.
    x = mix(row.astype(np.uint64) + np.uint64(1))
    first = np.add.reduceat(x, start) if len(keys) else x
    second = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), start) if len(keys) else x
    order = np.lexsort((second, first, length))
    new = np.r_[True, (np.diff(length[order]) != 0) | (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])][: len(order)]
    stands = order[new]
    weight = np.diff(np.append(np.flatnonzero(new), len(order)))
    many = length[stands]
    at = np.repeat(start[stands] - np.cumsum(many) + many, many) + np.arange(many.sum())
    row, token = row[at], np.repeat(np.arange(len(stands), dtype=np.int32), many)
    lists = np.cumsum(many) - many
    several = np.minimum.reduceat(label[row], lists) != np.maximum.reduceat(label[row], lists) if len(row) else np.zeros(0, bool)
    order = np.argsort(row, kind="stable")
    row, token = row[order], token[order]
    before = np.cumsum(weight[token]) - weight[token]
    begins = np.searchsorted(row, np.arange(len(own)))
    before -= before[np.minimum(begins, len(before) - 1)][row] if len(row) else before
    prefix = before <= (100 - percent) * own[row] // 100
    some = several[token]
    row, token, prefix = row[some], token[some], prefix[some]
    return Segments(size, ids, own=own, label=label, names=names, count=np.bincount(row, minlength=len(own)), token=token, prefix=prefix, weight=weight)


def _blocks(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items with `most` work together, or one."""
    ends, i = np.cumsum(work), 0
    while i < len(work):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _summed(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their weights."""
    if not len(code):
        return code, weight
    low = code.min()
    span = int(code.max() - low) + 1
    if span <= 8 * len(code):
        total = np.bincount(code - low, weight, span).astype(np.int64)
        some = np.flatnonzero(total)
        return some + low, total[some]
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[start], np.add.reduceat(weight[order], start)


def overlapping(s: Segments, percent: int, rows: int, direct: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of different labels, the first below `rows`, that share n-grams and do not differ too much in size, and
    how many these are. Not direct: only pairs that share n-grams of their prefixes."""
    n, width = len(s.own), max(len(s.weight), 1)
    take, listed, place, follow = s.lists(percent, not direct)
    of, weight = s.row[take], s.weight[s.token[take]]
    ends = np.searchsorted(of, np.arange(rows + 1))
    work = np.add.reduceat(np.append(follow, 0), ends)[:rows] * (np.diff(ends) > 0)
    has, begins = s.row * width + s.token, np.cumsum(s.count) - s.count
    for i, j in _blocks(work, BLOCK):
        e = slice(ends[i], ends[j])
        more = follow[e]
        at = np.repeat(place[e] - np.cumsum(more) + more, more) + np.arange(more.sum())
        code, overlap = _summed(np.repeat(of[e], more) * n + listed[at], np.repeat(weight[e], more))
        a, b = code // n, code % n
        other = s.label[a] != s.label[b]
        a, b, overlap = a[other], b[other], overlap[other]
        if not direct:
            overlap = np.zeros(len(a), np.int64)
            for k, m in _blocks(s.count[a], BLOCK):
                size = s.count[a[k:m]]
                at = np.repeat(begins[a[k:m]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                wanted = np.repeat(b[k:m], size) * width + s.token[at]
                found = has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted
                starts = np.cumsum(size) - size
                overlap[k:m] = np.add.reduceat(s.weight[s.token[at]] * found, starts)
        yield a, b, overlap


def similar(s: Segments, percent: int, rows: int, direct: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different labels, the first below `rows`, whose segments have the similarity."""
    for a, b, overlap in overlapping(s, percent, rows, direct):
        near = (100 + percent) * overlap >= percent * (s.own[a] + s.own[b])
        yield a[near], b[near]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with these edges on n vertices, some of whose edges join other ones of the same trees."""
    tree, out = np.arange(n), [(np.zeros(0, np.int64),) * 2]
    for a, b in pairs:
        while True:
            a, b = tree[a], tree[b]
            apart = a != b
            if not apart.any():
                break
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            order = np.lexsort((a, b))
            one = order[np.r_[True, np.diff(b[order]) != 0]]
            out.append((a[one], b[one]))
            up = np.arange(n)
            up[b[one]] = a[one]
            while not np.array_equal(up, up[up]):
                up = up[up]
            tree = up[tree]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _groups(s: Segments, percent: int, rows: int, direct: bool) -> tuple[np.ndarray, np.ndarray]:
    a, b = forest(((s.label[x], s.label[y]) for x, y in similar(s, percent, rows, direct)), len(s.names))
    return s.names[a], s.names[b]


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=SCHEMA)


def _sifted(table: pa.Table, percent: int) -> Iterator[pa.Table]:
    """A fragment's segments (fragment, id, keys, label) -> pairs of labels that may be linked, with a slice below 0; or, if
    that is much work, slices of it, one by one."""
    own, keys = grams(table.column("keys"))
    s = read(table.column("id").to_numpy(), own, table.column("label").to_numpy(), keys, percent)
    del own, keys
    (take, _, _, few), (_, _, _, all_) = s.lists(percent, True), s.lists(percent, False)
    looked = few * (1 + LOOK_UP * s.count[s.row[take]])
    direct = bool(all_.sum() <= looked.sum())
    work = np.bincount(s.row, all_, len(s.own)) if direct else np.bincount(s.row[take], looked, len(s.own))
    del take, few, all_, looked
    total = work.sum()
    fragment = table.column("fragment")[0].as_py()
    if total <= SLICE_WORK:
        a, b = _groups(s, percent, len(s.own), direct)
        yield _table([{"fragment": fragment, "slice": -1, "a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return
    last = np.searchsorted(s.own, 100 * s.own // percent, side="right")
    begins = np.append(np.cumsum(s.count) - s.count, len(s.token))
    for number, (i, j) in enumerate(_blocks(work, max(SLICE_WORK, int(total) // SLICES + 1))):
        end = int(last[j - 1])  # rows beyond are too large for those of the slice
        e = slice(begins[i], begins[end])
        token, new = np.unique(s.token[e], return_inverse=True)
        names, label = np.unique(s.label[i:end], return_inverse=True)
        arrays = {"own": s.own[i:end], "label": label, "names": s.names[names], "count": s.count[i:end], "token": new, "prefix": s.prefix[e], "weight": s.weight[token]}
        yield _table([{"fragment": fragment, "slice": number, "rows": j - i, "direct": direct} | {k: x.astype(ARRAYS[k]).tobytes() for k, x in arrays.items()}])


def sift(percent: int):
    """_sifted, all in one table."""
    return lambda table: pa.concat_tables(list(_sifted(table, percent)))


def sift_slice(percent: int):
    """A slice -> pairs of labels (a, b) that may be linked."""

    def run(table: pa.Table) -> pa.Table:
        s = Segments(**{k: np.frombuffer(table.column(k)[0].as_buffer(), t) for k, t in ARRAYS.items()})
        a, b = _groups(s, percent, table.column("rows")[0].as_py(), table.column("direct")[0].as_py())
        return pa.table({"a": a, "b": b})

    return run


def sift_groups(percent: int):
    """_sifted of a group, whose fragments are `parts` in number, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group = [(c, table.column(c)[0].as_py()) for c in ("key", "parts")]
        for out in _sifted(table, percent):
            for name, value in group:
                out = out.append_column(name, pa.array([value] * out.num_rows, pa.int64()))
            yield from out.select(GROUPS).combine_chunks().to_batches()

    return run


GROUPS = ["key", "parts", *SCHEMA.names]
GROUPS_DDL = "key long, parts long, " + DDL
