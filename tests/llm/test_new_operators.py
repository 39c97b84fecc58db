"""Conversation repair, whitening and licence scans against plain versions, on odd rows, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import conversations as cv
from voxelspark.llm import licenses, queries, whitening

ROWS = "conv_id long, turn long, role string, text string, c string, part int, kind int, sha string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, None) for r in rows], ROWS)


def plain_faults(rows):
    """[(turn, role, text)] in order -> [(role initial, fault)]."""
    seen, out = set(), []
    for _, role, text in rows:
        t = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain_audit(symbols):
    """Least (cost, edits) by trying every edit of every row, with up to two turns inserted at each place."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        out = dict(best)
        for state, (cost, edits) in best.items():
            for k in (1, 2):
                state = follows[state]
                out[state] = min(out.get(state, (math.inf, "")), (cost + 5 * k, edits + "I" * k))
        return out

    best = inserted({"": (0, "")})
    for initial, fault in symbols:
        new = {}
        for state, (cost, edits) in best.items():
            steps = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                left = 5 if fault else 0
                steps.append((follows[state], 1 + left, "R"))
                if initial == follows[state] or initial == "s" and state == "":
                    steps.append((initial, left, "K"))
            for to, more, e in steps:
                new[to] = min(new.get(to, (math.inf, "")), (cost + more, edits + e))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain_turns(rows, edits):
    out, i = [], 0
    for e in edits:
        if e != "I":
            row, i = rows[i], i + 1
        if e != "D":
            speaker = "user" if not out or out[-1][0][:1] in "sa" else "assistant"
            out.append((row[1] if e == "K" else speaker, "" if e == "I" else row[2]))
    return out


def plain_report(rows):
    """rows: (conv, turn, role, text) -> conv -> what a report has."""
    talks, out = {}, {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        symbols = plain_faults(said)
        cost, edits = plain_audit(symbols)
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        faults = [f for _, f in symbols]
        kept = plain_turns(said, edits)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha, len(kept))
    return out


def reported(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_talk(n, seed):
    r = random.Random(seed)
    role = lambda: r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
    text = lambda: r.choice(["Yes.", "No!", "Why", " ", "", None, "a b\n", "Fine? ", "so..  \t"])
    return [(r.choice([1, 2, 3, None]), r.choice([None, *range(n)]), role(), text()) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_random_rows(spark, seed):
    rows = random_talk(90, seed)
    df = talk(spark, rows).repartition(5)
    assert reported(cv.repair_report(df)) == plain_report(rows)


def test_repair_of_a_long_conversation(spark):
    """One conversation over many tasks, with rows that come many times, among short ones."""
    r = random.Random(5)
    rows = [(7, i, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"No {i}.", f"and {i}", ""])) for i in range(400)]
    rows += [(7, 40, "user", "Yes.")] * 700 + [(c, i, "user" if i % 2 == 0 else "assistant", f"{c} {i}.") for c in range(20) for i in range(4) if c != 7]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, turns = reported(cv.repair_report(talk(spark, rows))), cv.repaired_turns(talk(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_report(rows)
    said = [f"{t.role}:{t.text}" for t in sorted((t for t in turns if t.conv_id == 7), key=lambda t: t.place)]
    assert hashlib.sha256("\n".join(said).encode()).hexdigest() == found[7][-2] and len(turns) == sum(f[-1] for f in found.values())


def test_repair_without_rows(spark):
    none = talk(spark, [])
    assert cv.repair_report(none).count() == 0 and cv.repair_report(none, ids=none).count() == 0 and cv.repaired_turns(none).count() == 0
    ids = talk(spark, [(None, 1, "user", "x"), (4, None, None, None)])
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest(), 0)
    assert reported(cv.repair_report(none, ids=ids)) == {None: empty, 4: empty}


def test_repair_of_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000), (1, 1, "assistant", "x" * 1_000_000 + ".")]
    assert reported(cv.repair_report(talk(spark, rows))) == plain_report(rows)


def test_runs_of_any_length():
    """Powers and halves give what row after row gives; a very long run is quick."""
    r = random.Random(2)
    for _ in range(300):
        runs = [(r.randrange(9), r.choice([1, 1, 2, 3, 5, 8])) for _ in range(r.randrange(1, 6))]
        symbols = [("suax"[s % 4] if s < 8 else "u", "blank" if s == 8 else "truncated" if s >= 4 else "") for s, n in runs for _ in range(n)]
        edits, state = cv.audit(runs, cv.START, cv.END)
        assert (cv.seen_cost(runs), edits + cv.closing(state)) == plain_audit(symbols)
        assert cv.times(cv.whole(runs), cv.END)[cv.START] == cv.seen_cost(runs)
    edits, _ = cv.audit([(1, 1), (cv.BAD, 1 << 20), (2, 1)], cv.START, cv.END)
    assert edits == "K" + "D" * (1 << 20) + "K"


def same_by_sql(spark, sf_dir, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, sf_dir), c.sql(queries.oracle_sql()[name])
    assert sorted(sql.columns) == sorted(df.columns)
    want = sorted(tuple(r[sql.columns.index(x)] for x in df.columns) for r in sql.fetchall())
    assert sorted(map(tuple, df.collect())) == want and want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_repair_by_sql(spark, sf_dir, size):
    same_by_sql(spark, sf_dir.replace("sf0.001", size), "op11_conversation_repair", ["conversations"])


VECTORS = "vec_id long, embedding array<float>, x string, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def plain_whitening(rows, k):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    e, q = np.linalg.eigh((off / n).T @ (off / n) / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    some = e > 1e-12 * max(e[0], 1e-300) if len(e) else np.zeros(0, bool)
    e, q = e[some], q[:, some]
    return [i for i, _ in kept], n, (off * off).sum(axis=1), off / n @ q / np.sqrt(e), e / np.trace((off / n).T @ (off / n) / n)


@pytest.mark.parametrize(("n", "d", "k", "block"), [(300, 16, 8, 8), (40, 5, 8, 2), (6, 20, 8, 3), (200, 24, 3, 4), (50, 12, 4, 1)])
def test_whitening(spark, n, d, k, block):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, d)) @ rng.standard_normal((d, d))
    rows = [(i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
    rows += [(None, rows[0][1]), (3, rows[1][1]), (-1, None), (-2, [None] * d), (-3, [math.nan] * d), (-4, [math.inf] + [0.0] * (d - 1)), (-5, [])]
    ids, count, deviation, white, explained = plain_whitening(rows, k)
    got = whitening.whiten(vectors(spark, rows).repartition(3), k=k, block=block).collect()
    c = white.shape[1]
    assert len(got) == len(ids) * c and {r.n for r in got} == {count} and max(r.identity_error for r in got) < 1e-9
    ours, place = {}, {}
    for r in got:
        ours.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        place[r.component] = r.explained
    assert np.allclose([place[j + 1] for j in range(c)], explained, rtol=1e-9)
    signs = {}
    for i, dev, w in zip(ids, deviation.tolist(), white, strict=True):
        for j in range(c):
            value = ours[i, dev][j + 1][0]
            signs.setdefault(j, round(value / w[j]) if abs(w[j]) > 0.1 else None)
            if signs[j] is None:
                del signs[j]
            assert math.isclose(abs(value), abs(w[j]), abs_tol=1e-8)
            if j in signs:
                assert math.isclose(value, signs[j] * w[j], abs_tol=1e-8)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [math.nan, 1.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.5]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and math.isclose(line[0].explained, 1.0)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5])]))


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, _, deviation, white, explained = plain_whitening(rows, 8)
    got = queries.op12_embedding_whitening(spark, sf_dir).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 8 * len(ids)
    ours = np.array([[by[i, j + 1].whitened for j in range(8)] for i in ids])
    assert np.allclose(ours * np.sign((ours * white).sum(axis=0)), white, atol=1e-9)
    assert [by[i, 1].deviation for i in ids] == deviation.tolist()
    assert np.allclose([by[ids[0], j + 1].explained for j in range(8)], explained, rtol=1e-12)


def plain_scan(text):
    low = (text or "").translate(brute.LOWER)
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    words = find(low)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base, more, most, n = {x for _, x in places}, set(), 0.0, 0
    for line in low.split("\n"):
        held = set(find(line))
        for _, label, notice in licenses.TEMPLATES:
            want = set(find(notice.translate(brute.LOWER)))
            if 100 * len(held & want) >= 90 * len(want):
                more, most, n = more | {label}, max(most, len(held & want) / len(want)), n + 1
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else most, n)


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    *brute.ODD,
    (20, "CC-BY cc by, CC_BY\tcc\nby ccby cc by"), (21, "All rights reserved"), (22, "the GNU General Public License. All Rights Reserved!"),
    (23, "x\nLicensed under the Apache License, Version 2.0.\ny"), (24, "Licensed under\nthe Apache License, Version 2.0"), (25, "apache license 2 0 the under VERSION LICENSED and more words"),
    (26, NOTICE + ' (the "Software"), to deal in the Software without restriction'), (27, NOTICE), (28, f"{NOTICE} (the 'software'), to deal in a Software with restriction"),
    (29, "ünder CC BY-NC 4.0 licensed ünder"), (30, "Licensed under CC BY-NC 4.0.\n" * 40), (31, "Released\x00under\x7fthe{MIT}License"), (32, "cc " * 50_000 + "by " * 50_000),
    (33, "no licence here " * 100_000), (34, "🙂 cc by 🙂 all rights reserved 日本"), (23, "x\nLicensed under the Apache License, Version 2.0.\ny"),
]


def test_license_scan(spark):
    docs = brute.table(spark, TEXTS).withColumns({c: F.lit("z") for c in ("row", "base", "blocks", "id", "lower", "labels")})
    got = sorted((tuple(r) for r in licenses.license_scan(docs).collect()), key=str)
    assert got == sorted(((i, *plain_scan(t)) for i, t in TEXTS), key=str)
    lines = {(r.doc_id, r.line, r.template) for r in licenses.license_blocks(docs).collect()}
    assert {(23, 1, "apache-2.0"), (25, 0, "apache-2.0"), (26, 0, "mit-grant")} <= lines and not {i for i, _, _ in lines} & {24, 27, 29}


def test_license_scan_of_odd_tables(spark):
    empty = brute.table(spark, [])
    assert licenses.license_scan(empty).count() == 0 and licenses.license_blocks(empty).count() == 0
    one = brute.table(spark, [(1, "all rights reserved")])
    assert licenses.license_scan(one, templates=[]).first().labels == "reserved"


def test_license_scan_by_sql(spark, sf_dir):
    same_by_sql(spark, sf_dir, "op13_license_scan", ["documents"])


def plain_tree(points, n_shards):
    """Shards by sorting: the nearest cut to the weighted median along the dimension that is widest against the whole."""
    from voxelspark.llm import sharding

    def deviation(rows, d):
        w, x = np.array([float(r["w"]) for r in rows]), np.array([r[d] / 2.0**sharding.BITS for r in rows])
        return math.sqrt(max(0.0, (w * x * x).sum() / w.sum() - ((w * x).sum() / w.sum()) ** 2))

    whole, out = [deviation(points, d) for d in sharding.DIMENSIONS], {}

    def split(rows, first, leaves):
        if leaves == 1 or not rows:
            return out.update({(r["digest"], r["salt"]): first for r in rows})
        wide = [round(deviation(rows, d) / s, 9) if s > 0 else -1.0 for d, s in zip(sharding.DIMENSIONS, whole, strict=True)]
        d = sharding.DIMENSIONS[wide.index(max(wide))]
        rows = sorted(rows, key=lambda r: (r[d], r["tie"]))
        target, half, below = sum(r["w"] for r in rows) * (leaves // 2) / leaves, leaves // 2, 0
        for k, r in enumerate(rows):
            if below + r["w"] >= target:
                k += below + r["w"] - target <= target - below
                break
            below += r["w"]
        split(rows[:k], first, half)
        split(rows[k:], first + half, leaves - half)

    split(points, 0, n_shards)
    return out


def test_shards_of_a_plain_tree(spark):
    from voxelspark.llm import sharding

    r = random.Random(8)
    rows = [(bytes([i % 251, i // 251]), i % 4, r.randrange(1, 3000), i * 7919 % (1 << 20), r.randrange(1 << 20), r.randrange(3) << 25, r.choice([5, 9]) << 20, r.randrange(1 << 30)) for i in range(400)]
    points = spark.createDataFrame(rows, "digest binary, salt int, w long, tie long, d_size long, d_source long, d_lang long, d_id long")
    for n in (1, 2, 5, 16):
        got = {(bytes(x.digest), x.salt): x.shard for x in sharding.kd_tree(points, n, 0.0).collect()}
        assert got == plain_tree([{**x.asDict(), "digest": bytes(x.digest)} for x in points.collect()], n)


def test_shards_with_a_third_of_all_rows_alike(spark):
    from voxelspark.llm import sharding

    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text number {i} " * (1 + i % 40)) for i in range(3000)]
    rows += [(None, "x " * 40_000), (None, None), (5, None), (5, None)]
    docs = brute.table(spark, rows)
    got = sharding.kd_shards(docs, n_shards=8).collect()
    assert len(got) == len(rows)
    size, groups = {}, {}
    for x in got:
        size[x.shard] = size.get(x.shard, 0) + x.size
        groups.setdefault((x.text_crc32, x.size), set()).add(x.shard)
    assert max(size.values()) - min(size.values()) < 0.06 * sum(size.values()) / 8 + 80_001
    assert sum(len(g) > 1 for g in groups.values()) <= 7
    for k in size:
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
