"""Each operator against a plain version: odd rows, ties, empty tables, clashing columns, and the driver's documents."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import chat_template, exact_dedup, langid, mixing, ngram_join, packing, pii, quality, queries, sharding, shingles, token_count
from voxelspark.llm.components import components

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SEEN = brute.ODD


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()
    return brute.table(spark, SEEN + [(r.doc_id + 1000, r.text) for r in own]).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return brute.table(spark, [])


def near_copies(n, seed=3):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = f"v{r.randrange(10**6)}"
        out.append((i + 1, " ".join(w)))
    return out


def test_ngram_components(docs, rows, empty):
    want = brute.components([r for r in rows if r[0] is not None], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got.pop(None) == (2, None) and got == want
    assert ngram_join.ngram_components(empty).count() == 0


@pytest.mark.parametrize("window", [1, 32])
def test_ngram_components_of_a_large_group(spark, window):
    """With a window of 1 nearly all lists are long, so the far pass has to find what the near pass leaves."""
    made = near_copies(90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(brute.table(spark, made), window=window).collect()}
    assert got == brute.components(made, 4, 85)


def test_nodes_that_agree_in_32_bits_are_two():
    """Two sets share all n-grams; their nodes differ only beyond 32 bits."""
    keys, of = np.arange(5, dtype=np.uint32), np.zeros(5, np.uint16)
    rows = [(0, part, np.array([7 + (part << 32)], np.int64), of, keys) for part in (0, 1)]
    counts = ngram_join._peel(ngram_join._blobs(rows, ngram_join.PEEL)).to_pylist()
    assert [np.frombuffer(r["shared"], np.uint32).tolist() for r in counts] == [[5], [5]]


@pytest.mark.parametrize("window", [1, None])
def test_overlaps_by_stretches(monkeypatch, window):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, 12).astype(np.uint64)) for _ in range(40)]
    ids, sizes = np.arange(40), np.array([len(x) for x in sets])
    if window is None:
        group = pa.table({"id": ids, "n": sizes, "keys": pa.array([x.tobytes() for x in sets], pa.binary()), "label": ids % 7})
    else:
        group = ngram_join._blobs([(0, ids, sizes, sizes, np.concatenate(sets))], ngram_join.SEGMENTS)
    found = []
    for most in (1, 50, 200_000):
        monkeypatch.setattr(ngram_join, "STRETCH", most)
        found.append(ngram_join._overlaps(50, 3, window)(group).to_pylist())
    assert found[0] == found[1] == found[2] and found[0]


def test_one_of_each(spark):
    made = near_copies(30) + [(100, None), (None, "free of ids")]
    kept = {r.doc_id for r in ngram_join.one_of_each(brute.table(spark, made), 5, 80).collect()}
    assert kept == {c for _, c in brute.components(made[:-1], 5, 80).values()} | {None}


def test_ngram_components_of_rows_that_share_an_id(spark):
    """Each row is a document of its own: id 1 has a copy of 7 and a text of its own, and 9 repeats a row."""
    own, other = "a b c d e f g h", "k l m n o p q r"
    made = [(7, own), (1, own), (1, other), (9, other + " s"), (9, other + " s"), (4, "x y z"), (4, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(brute.table(spark, made).repartition(3), percent=60).collect())
    assert got == [(1, 5, 1), (1, 5, 1), (4, 0, 4), (4, 1, 4), (7, 5, 1), (9, 6, 1), (9, 6, 1)]


@pytest.mark.parametrize("part", [1, 2000, 1 << 22])
def test_ngram_components_with_a_line_in_all(spark, monkeypatch, part):
    """A common line, copies within and across the parts that are compared before they are sent."""
    monkeypatch.setattr(ngram_join, "PART", part)
    r = random.Random(part)
    line = "this line is in every text of the table"
    made = [(i, line + " " + " ".join(f"w{r.randrange(4000)}" for _ in range(60))) for i in range(60)]
    made += [(100 + i, made[i % 7][1] + f" {'end' * (i % 3)}") for i in range(40)] + [(200 + i, line) for i in range(9)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(brute.table(spark, made).repartition(5)).collect()}
    assert got == brute.components(made, 4, 85)


def test_words_of_long_texts(monkeypatch):
    """A text over two slices is hashed part by part, also with a word longer than a slice."""
    texts = ["ab cd  ef\n" * 40 + "x" * 300 + " end", "short one"]
    whole = shingles.shingle_sets(pa.array(texts), 3)
    monkeypatch.setattr(shingles, "SLICE", 64)
    monkeypatch.setattr(shingles, "_powers", {})
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(pa.array(texts), 3), strict=True))


def test_shingles_of_slices():
    texts = ["A b C d E", None, "", "a  b\tc\nd e", "x y", " x\x0by ", "Éa b c d"] * 3
    sizes, keys = shingles.shingle_sets(pa.array(texts), 4)
    sets = [frozenset(x.tolist()) for x in np.split(keys, np.cumsum(sizes)[:-1])]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[i] == sets[j]) == (brute.shingles(a, 4) == brute.shingles(b, 4))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (3, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_token_counts(docs, rows, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i or 0), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    for chunk, overlap in ((16_384, 256), (300, 8)):  # with 300, most documents are cut, and some overlaps hold no space
        got = token_count.count_tokens(docs, PIECES, chunk=chunk, overlap=overlap).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_count.count_tokens(empty, PIECES).count() == 0


def test_quality(docs, rows, empty):
    got = sorted(((r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    assert got == sorted(((i or 0), *brute.rules(t)) for i, t in rows)
    assert not quality.quality(docs).where("kept and base_failed").count() and quality.quality(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == quality.quality(docs).where("kept").count()


def test_quality_agrees_with_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and not kept").count() > 0.8 * judged.where("quality = 0").count()


def library_ids(path, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def odd_texts():
    r = random.Random(7)
    letters = "aéßΣς ,.'’|<>endoftxEND12ﬁǺ̀  \x1c\x0b日本¼²_-!ʼnİǰẞKJ̌"
    plain = "aAbBéÉüÜ ,.!$\n"
    some = ["".join(r.choice(letters) for _ in range(50)) for _ in range(1500)] + ["".join(r.choice(plain) for _ in range(40)) for _ in range(500)]
    return some + ["<|endoftext|>, <|ENDOFTEXT|>. don't, it's.", "", None, "a", " ", "J\u030c j\u030c"]


@pytest.mark.parametrize("together", [1, 60, 1 << 22])
def test_word_tokens_against_the_library(monkeypatch, together):
    """Slices of any size; with small ones, most texts are cut at white space."""
    monkeypatch.setattr(packing, "TOGETHER", together)
    texts = odd_texts()
    got = [x.tolist() for x in packing.WordTokens(WORDS).ids(pa.array([None if t is None else t.encode() for t in texts]))]
    assert got == library_ids(WORDS, texts)


def test_word_tokens_of_known_words_and_none(monkeypatch):
    """Batches of words that the worker knows, of empty texts only, and a worker that forgets."""
    tokens = packing.WordTokens(WORDS)
    for _ in range(2):
        assert [x.tolist() for x in tokens.ids(pa.array([b"known words", b"known"]))] == library_ids(WORDS, ["known words", "known"])
        assert [x.tolist() for x in tokens.ids(pa.array([b"", None, b" "]))] == [[], [], []]
    assert list(tokens.ids(pa.array([], pa.binary()))) == []
    monkeypatch.setattr(packing, "CACHE_STEMS", 3)
    texts = odd_texts()[:60]
    for _ in range(2):
        assert [x.tolist() for t in texts for x in tokens.ids(pa.array([t.encode()]))] == library_ids(WORDS, texts)


def test_other_tokenizers_take_whole_texts(tmp_path):
    import json

    with open(WORDS, encoding="utf-8") as f:
        parts = json.load(f)
    parts["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(parts, f)
    tokens, texts = packing.WordTokens(path), ["One TWO  three", "", "Aé\n"]
    assert not tokens.by_word and [x.tolist() for x in tokens.ids(pa.array([t.encode() for t in texts]))] == library_ids(path, texts)


def check_packing(spark, rows, got, capacity=2048):
    want = []
    for i, ids in zip([i for i, _ in rows], library_ids(WORDS, [t for _, t in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want += [(i or 0, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) <= 1.02 * -(-sum(r.length for r in got) // capacity) + 1


def test_packing(spark, docs, rows, empty):
    check_packing(spark, rows, packing.pack(docs.repartition(5), WORDS).collect())
    check_packing(spark, rows, packing.pack(docs, WORDS, capacity=32).collect(), 32)
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_of_empty_texts_only(spark):
    made = [(i, None if i % 2 else "") for i in range(40)]
    check_packing(spark, made, packing.pack(brute.table(spark, made), WORDS).collect())


def test_packing_of_equal_batches_in_one_worker(spark):
    made = [(i, "the same words again") for i in range(60)]
    check_packing(spark, made, packing.pack(brute.table(spark, made).coalesce(1), WORDS).collect())


def test_packing_against_sequential_best_fit():
    """The rounds fill about as few sequences as best fit in decreasing order, one piece at a time."""
    r = random.Random(5)
    for capacity, most in ((64, 64), (200, 90), (64, 9)):
        lengths = [r.randrange(1, most + 1) for _ in range(1500)]
        gaps = []
        for n in sorted(lengths, reverse=True):
            best = min((g for g in gaps if g >= n), default=None)
            if best is not None:
                gaps.remove(best)
            gaps.append((capacity if best is None else best) - n)
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        places = packing.arrange(counts, capacity)
        sequences, used = set(), defaultdict(int)
        for n, k in counts.items():
            found, offset = places.find(np.full(k, n), np.arange(k))
            sequences.update(found.tolist())
            for s, o in zip(found.tolist(), offset.tolist(), strict=True):
                used[s] = max(used[s], o + n)
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= capacity  # gapless
        assert len(sequences) <= 1.01 * len(gaps) + 1


def test_best_fit_of_many_tiny_pieces(spark):
    pieces = spark.range(5000).select(F.col("id").alias("pid"), (F.col("id") % 7 + 1).alias("length"))
    got = packing.best_fit(pieces, 2048).join(pieces, "pid").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in got) == 5000 and max(r.n for r in got) <= 2048 and len(got) <= 12


def test_sharding(docs, rows, empty):
    got = sharding.kd_shards(docs, n_shards=4).collect()
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(4))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    assert sharding.kd_shards(empty).count() == 0
    assert sharding.kd_shards(docs, n_shards=None, target_bytes=10**9).agg(F.max("shard")).first()[0] == 0


def test_pii(spark, docs, rows, empty):
    hard = "é 1.2.3.4.5 a@b.c_d@e.f a@b.c..d@e.f @x +1 (555) 123-4567 4111 1111 1111 1111 999.1.1.1 4111-1111-1111-11112 1 4111111111111111 a.b+c@d-e.co.uk. 001.002.003.255 +49 30 123"
    made = [(500, hard), (501, "1" * 4000 + " a@b.c"), (502, "ab" * 2000 + "@" + "x." * 1500 + "y")]
    got = pii.pii_spans(docs.unionByName(brute.table(spark, made))).collect()
    texts = defaultdict(set)
    for i, t in rows + made:
        texts[i].add(hashlib.sha256(",".join(brute.spans(t)).encode()).hexdigest())
    assert len(got) == len(rows) + 3 and all(r.base_sha256 in texts[r.doc_id] for r in got)
    assert next(r.spans for r in got if r.doc_id == 500) == ",".join(brute.spans(hard))
    assert pii.pii_spans(empty).count() == 0


def test_pii_terms_that_disclose(spark):
    made = [(i, f"Report {i} says that zanzibarus met someone at agent@secret.org and more words number{'x' * i}") for i in range(8)]
    made += [(100 + i, f"Another text {'y' * i} says that someone met more words") for i in range(40)]
    made += [(200, "Here zanzibarus stands alone, Zanzibarus!")]
    got = {r.doc_id: r for r in pii.pii_spans(brute.table(spark, made), bits=1.0).collect()}
    assert got[200].spans == "term:5:15,term:30:40" and got[0].n_term >= 1 and got[120].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(brute.table(spark, made), bits=1.0).collect()}
    assert clean[200] == "Here [TERM] stands alone, [TERM]!" and "agent" not in clean[3] and clean[120] == made[8 + 20][1]


def test_pii_of_very_many_labels(spark):
    made = [(1, "to a@b" + ".c" * 45_000 + " or d@e.f"), (2, "a@b" + ".c" * 40_001), (3, "a@b" + ".c" * 60_000 + "..d g@h.i")]
    got = {r.doc_id: r for r in pii.pii_spans(brute.table(spark, made)).collect()}
    for i, t in made:
        assert got[i].base_sha256 == hashlib.sha256(",".join(brute.spans(t)).encode()).hexdigest()


def test_pii_of_very_many_spans(spark):
    """Tens of thousands of spans in a text take time in proportion, and sanitising too."""
    import time

    made = [(1, "é 😀 " + "mail a1@b.org or +1 555 123 4567, " * 20_000), (2, "ip 1.2.3.4, "), (3, "1.2.3.4" + " 5.6.7.8" * 70_000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.pii_spans(brute.table(spark, made)).collect()}
    for i, t in made:
        assert got[i].base_sha256 == hashlib.sha256(",".join(brute.spans(t)).encode()).hexdigest()
    assert got[1].n_spans == 40_000 and time.time() - began < 600
    clean = {r.doc_id: r.text for r in pii.sanitise(brute.table(spark, made)).collect()}
    assert clean == {1: "é 😀 " + "mail [EMAIL] or [PHONE], " * 20_000, 2: "ip [IP], ", 3: "[IP]" + " [IP]" * 70_000}
    assert all(got[i].clean_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items())


def test_redaction_of_overlapping_spans(spark):
    rows = spark.createDataFrame([("abcdefghij", [(2, 5, "ip"), (4, 7, "card"), (9, 10, "email")]), ("é", []), ("😀x", [(0, 1, "ip")])], "t string, s array<struct<start: int, end: int, kind: string>>")
    assert [r[0] for r in rows.select(pii.redacted(F.col("t"), F.col("s"))).collect()] == ["ab[IP]hi[EMAIL]", "é", "[IP]x"]


def test_pii_terms_at_the_parameters_of_the_query(spark):
    """Far from their entity, short, of strings that occur once each, and of a string in a quarter of the texts."""
    far = "lorem " * 60
    made = [(i, f"Zed {far} write to person{i}@mail.org") for i in range(8)]
    made += [(20 + i, f"quorx {far} call +1 (555) 123-4567 {'z' * i}") for i in range(12)]
    made += [(100 + i, f"{far} someone {'y' * i}") for i in range(40)]
    made += [(200, "zed and Quorx and lorem"), (201, "zed and Quorx and lorem")]
    got = {r.doc_id: r for r in pii.pii_spans(brute.table(spark, made)).collect()}
    assert got[200].spans == got[201].spans == "term:0:3,term:8:13" and got[140 - 1].n_term == 0
    assert got[0].n_term == 3 and got[25].n_term == 2  # zed, write, to; quorx, call


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((i or 0, best[t or ""] or 0, len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for fan_in in (2, 8):
        got = exact_dedup.exact_groups(docs.repartition(7), fan_in=fan_in).collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] or None for w in want if w[3] or not w[0]}


def test_drop_copies_by_id_and_text(spark):
    made = [(5, "A"), (5, "B"), (9, "B"), (None, "C"), (None, "C"), (3, "C"), (None, "D"), (None, "D"), (7, "E"), (7, "E"), (None, None), (4, "")]
    kept = exact_dedup.drop_copies(brute.table(spark, made).repartition(3))
    assert kept.columns == brute.table(spark, []).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "D"), (3, "C"), (4, ""), (5, "A"), (7, "E"), (9, "B")]


def test_language(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 !? ²", "de", "s", 0), (None, "le la des", None, "s", 0)], docs.schema)
    got = langid.language_of(docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 3
    held = [r for r in got if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (-1, -2))
    assert langid.language_of(empty).count() == 0


def test_language_of_long_and_repeated_texts(spark, monkeypatch):
    """A long text is scored part by part, as if whole; equal rows have equal results."""
    rows = [(i, ("le la des une " if i % 2 else "the and of to ") * 30) for i in range(60)]
    table = spark.createDataFrame([(i, "fr" if i % 2 else "en", t) for i, t in rows], "id long, lang string, text string")
    model = langid.learn(table)
    texts = ["the cat and the dog " * 4000, "la vie des une " * 4000, "", None, "x", "ab", "the cat and the dog " * 4000]
    whole = model.predict(texts)
    assert whole[0] == ["en", "fr", "und", "und", whole[0][4], whole[0][5], "en"] and whole[1][0] == whole[1][6]
    monkeypatch.setattr(langid, "SLICE", 50)
    assert model.predict(texts)[0] == whole[0] and np.allclose(model.predict(texts)[1], whole[1])


def test_rare_classes_stay_in_the_sample(spark):
    """Two rows of 3,000 have a class of their own; the sample is of about 50."""
    rows = [(i, "aaa bbb" if i else "xyz zyx", "com" if i > 1 else "rare") for i in range(3000)]
    model = langid.learn(spark.createDataFrame([(i, x, t) for i, t, x in rows], "id long, lang string, text string"), sample=50)
    assert model.langs == ["com", "rare"]
    docs = brute.table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(-i, "gone") for i in range(1, 100)], "doc_id long, domain string")
    assert mixing.learn_domains(docs, labels, sample=50).names == ["com", "rare"]


def test_chat(spark, sf_dir):
    hard = "\\### Assistant: </turn> ok\\\\a :<#"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", None), (1, 1, "assistant", hard), (2, None, "a: #", "x\n"), (None, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    text = {r.conv_id: r for r in chat_template.format_conversations(table).collect()}
    assert chat_template.read_back(text[1].formatted) == [("user", ""), ("assistant", hard), ("assistant", hard)]
    assert chat_template.read_back(text[2].formatted) == [("a: #", "x\n")] and text[None].n_turns == 1
    d = {r.conv_id: r for r in chat_template.digests(chat_template.format_conversations(table)).collect()}
    assert d[1].loss_chars == 2 * len(hard) and d[1].loss_sha256 == hashlib.sha256((hard * 2).encode()).hexdigest()
    assert queries.op10_chat_formatting(spark, sf_dir).where("conv_id = -7").first().n_turns == 2
    assert chat_template.format_conversations(table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "double", "date", "decimal(9,0)"])
def test_chat_of_any_type_of_id(spark, kind):
    long = "very long " * 300_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (None, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    table = rows.withColumn("conv_id", F.date_from_unix_date("conv_id") if kind == "date" else F.col("conv_id").cast(kind))
    got = chat_template.digests(chat_template.format_conversations(table)).collect()
    assert sorted((r.n_turns, r.loss_chars) for r in got) == [(1, 0), (2, len(long))]


def test_template_language():
    t = '{% for m in messages %}{% if m.role == "a" and not false_ %}{{ "x" + "y" }}{% generation %}{{ m.text | upper }}{% endgeneration %}{% else %}-{% endif %}{% endfor %}'
    with pytest.raises(KeyError):
        chat_template.compile_template(t)([{"role": "a", "text": "q"}])
    folded = chat_template.fold(chat_template.parse('a{{ "b" + "c" | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}'))
    assert folded == (chat_template.Emit(chat_template.Const("abCd")),)
    text, spans = chat_template.compile_template(t.replace(" and not false_", ""))([{"role": "a", "text": "q"}, {"role": "b", "text": "z"}])
    assert (text, spans) == ("xyQ-", [(2, 3)])
    for bad in ("{{ a", "{% for x %}", "{{ x | nofilter }}", "{{ x.__class__ }}", "{% if x %}"):
        with pytest.raises((chat_template.TemplateError, KeyError)):
            chat_template.compile_template(bad if bad != "{{ a" else "{{ + }}")([])


def test_mixing(spark, sf_dir, empty):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.domain_labels(spark, sf_dir)
    r = mixing.mix_rates(docs, labels, queries.TARGETS, "good").collect()
    assert len(r) == docs.count() and all(x.rate >= 0 and abs(x.copies - x.rate) < 1 for x in r)
    assert all(abs(x.wanted - x.reached) < 1e-3 for x in r)
    assert mixing.mix_rates(empty, labels, queries.TARGETS, "good").count() == 0
    assert mixing.mix_rates(docs, labels.limit(0), queries.TARGETS, "good").where("rate <> 1 or copies <> 1").count() == 0
    again = mixing.mixed(docs, labels, queries.TARGETS, "good")
    assert again.columns == docs.columns and again.count() == sum(x.copies for x in r)


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([4, 1, 1], 400)
    frame = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(1, 900, 400), p, strict=True)], "n_tokens long, p array<double>")
    rates = mixing.fit_rates(frame, ["a", "b", "c"], {"a": 0.8, "b": 0.15, "c": 0.05}, "a", 1.0)
    n = np.array([r.n_tokens for r in frame.collect()])
    r, _ = rates.replay(p)
    got = (n * r) @ p
    assert r.min() >= 0 and np.allclose(got / got.sum(), [0.8, 0.15, 0.05], atol=2e-3)


def test_mixing_of_odd_rows(spark, docs, rows):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    labels = spark.createDataFrame([(6, "good"), (8, "poor"), (7, "good"), (4, None), (None, "good"), (999_999, "poor")], "doc_id long, domain string")
    got = mixing.mix_rates(docs, labels, {"good": 0.5, "poor": 0.5}, "good").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(brute.WORD.findall(t or ""))) for i, t in rows)
    twice = [r for r in got if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    again = mixing.mixed(docs, labels, {"good": 0.5, "poor": 0.5}, "good")
    assert again.columns == docs.columns and sorted(r.doc_id or 0 for r in again.collect()) == sorted(r.doc_id or 0 for r in got for _ in range(r.copies))


def test_targets_out_of_reach_are_told(spark):
    frame = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.5, 0.5])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="mixing"):
        rates = mixing.fit_rates(frame, ["a", "b"], {"a": 0.9, "b": 0.1}, "a", 1.0)
    assert not rates.close and np.allclose(rates.reached[0], rates.reached[1])


def test_domain_classifier_on_held_out_labels(spark, sf_dir):
    """Fitted on half of the labels, it tells most of the others."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.domain_labels(spark, "/root/testdata/sf0.01")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    domains = mixing.learn_domains(docs, labels.where(half == 0))
    told = mixing.measure(docs, domains).join(labels.where((half == 1) & F.col("domain").isNotNull()), "doc_id").collect()
    right = sum(domains.names[int(np.argmax(r.p))] == r.domain for r in told)
    assert len(told) > 150 and right >= 0.8 * len(told)  # from about 200 labels


def test_sql_twins(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, found = queries.queries()[name](spark, sf_dir), c.sql(sql)
        cols = sorted(df.columns)
        assert sorted(found.columns) == cols
        at = [found.columns.index(x) for x in cols]
        assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = pipeline.table(spark, sf_dir, "documents")
    columns = docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, pipeline.durable(stage(spark, docs, sf_dir))
        assert i == 4 or docs.columns == columns
        if i == 0:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.quality(before).where("kept").collect()}
        elif i == 1:
            assert docs.count() == before.select("text").distinct().count()
        elif i == 2:
            made = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, c in brute.components(made, 5, 80).values()}
        elif i == 4:
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, repeats, ties, clashing names and no rows at all, through every stage."""
    import corpus_pipeline as pipeline

    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    own = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = [*(t for _, t in brute.ODD), *own, *own[:9]]
    rows = [(i if i % 7 else None, t, None if i % 5 == 0 else "en", None, None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, domain string, place string, __sha string, __gone string"
    for made in (rows + rows[:20], []):
        docs = spark.createDataFrame(made, schema)
        for i, (_, stage) in enumerate(pipeline.STAGES):
            docs = pipeline.durable(stage(spark, docs, str(tmp_path)))
            assert i == 4 or docs.schema.names == schema.replace(" long", "").replace(" string", "").split(", ")
        assert (docs.count() > 0) == bool(made)


CLASHES = "id text domain place row key p draw lost __id __sha __sha0 __gone __m __n".split()


def test_clashing_columns(spark):
    """Operators and stages on documents that have columns of the names that they use themselves."""
    made = [(i, f"word{i % 7} " * 30 + f"and more of number {i % 7} here") for i in range(20)] + [(3, "word3 " * 30 + "and more of number 3 here")]
    names = ["doc_id", *CLASHES]
    docs = spark.createDataFrame([(i, *[t if c == "text" else f"{c}{i}" for c in CLASHES]) for i, t in made], "doc_id long, " + ", ".join(f"{c} string" for c in CLASHES))
    labels = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(20)], "doc_id long, domain string")
    assert mixing.mix_rates(docs, labels, {"good": 0.5, "poor": 0.5}, "good").count() == 21
    for out, n in (
        (mixing.mixed(docs, labels, {"good": 0.5, "poor": 0.5}, "good"), None),
        (exact_dedup.drop_copies(docs), 7),
        (ngram_join.one_of_each(docs), None),
        (quality.keep_good(docs), None),
    ):
        assert out.columns == names and (n is None or out.count() == n) and out.select("lost").count() == out.count()


def test_mixing_of_unknown_domains(spark):
    docs = spark.createDataFrame([(i, "fine words " * 9 if i % 2 else "bad junk " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(20)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="no label tells"):
        got = mixing.mix_rates(docs, labels, {"good": 0.4, "poor": 0.2, "toxic": 0.4}, "good").collect()
    assert {r.lost for r in got} == {0.4}
    with pytest.warns(UserWarning, match="no label tells"):
        rates = mixing.fit_rates(mixing.measure(docs, mixing.learn_domains(docs, labels)), ["good", "poor"], {"toxic": 1.0}, "good", 1.0)
    assert rates.lost == 1.0 and not rates.close


def test_mixing_against_whole_vectors(spark, sf_dir):
    """The rates that documents replay are those of a projected gradient that keeps all of them in memory."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.domain_labels(spark, sf_dir)
    domains = mixing.learn_domains(docs, labels)
    measured = mixing.measure(docs, domains).cache()
    targets, names = {"good": 0.5, "poor": 0.3, "toxic": 0.2}, domains.names
    fitted = mixing.fit_rates(measured, names, targets, "good", 1.2)
    rows = measured.collect()
    p, n = np.array([r.p for r in rows]), np.array([float(r.n_tokens) for r in rows])
    r = y = np.ones(len(p))
    wanted = np.array([targets[x] for x in names])
    goal = wanted * 1.2 * (n @ p)[names.index("good")] / wanted[names.index("good")] / n.sum()
    weigh = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9, hermitian=True)
    steps = 0
    while np.abs((n * r) @ p / n.sum() - goal).max() > mixing.CLOSE * goal.sum() and steps < mixing.ITERATIONS:
        new = np.maximum(0.0, y - p @ (weigh @ ((n * y) @ p / n.sum() - goal)))
        r, y = new, new + steps / (steps + 3) * (new - r)
        steps += 1
    assert steps and len(fitted.gradients) == steps and np.allclose(fitted.goal, goal)
    assert np.allclose(fitted.replay(p)[0], r, atol=1e-6) and np.allclose(fitted.reached, (n * r) @ p / n.sum(), atol=1e-6)
