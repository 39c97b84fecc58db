"""Personal data: pattern spans, and terms that reveal the entities found, in DataFrame operations only.

Patterns give the base spans of e-mail addresses, IP addresses, card numbers and phone numbers. The terms of the texts,
runs of letters outside e-mail addresses, are then held against the whole corpus. An entity is one found string, or all
strings of a kind together. With n(t, e) texts that have term t and entity e anywhere, n(t) texts with t, n(e) texts
with e, N texts and q = n(e) / N, the pointwise mutual information, smoothed by one text that follows q, is
pmi = log2((n(t, e) + q) / (n(t) + 1) / q), and at most about log2(1 / q). Term t discloses e when n(t, e) >= support,
P(e | t) = n(t, e) / n(t) >= certainty, pmi / log2(1 / q) >= certainty (so that frequent entities are not shut out) and
the texts together give n(t, e) * pmi >= bits (so that chance does not disclose them). Disclosing terms are spans of
kind `term` in every text that has them. Equal texts count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let

KINDS = ("email", "ip", "card", "phone")
#: The patterns find the same leftmost matches as the plain ones, but don't retry inside a run, don't recurse deeply on
#: long inputs, and (card) match only runs of 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of its gate has no match of the pattern.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
SPAN = "array<struct<start: int, end: int>>"
#: Terms that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Elements of an array up to which each one's running value is made from all before it.
SHORT = 16


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The array of join over all elements up to each one, join being associative. In a short array, as nearly all are, each
    is joined from the first on. Else every level doubles how far an element looks back, and arrays that are shorter pass
    a level as they are: n log n for any length."""

    def level(back: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) <= back, a).otherwise(F.transform(a, lambda x, i: F.when(i >= back, join(F.get(a, i - back), x)).otherwise(x)))

    def doubled(a: Column) -> Column:
        for k in range(31):
            a = let(a, level(1 << k))
        return a

    def direct(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.aggregate(F.slice(a, F.lit(2), i), F.get(a, F.lit(0)), join))

    return let(values, lambda a: F.when(F.size(a) <= SHORT, direct(a)).otherwise(doubled(a)))


def find_spans(text: Column, pattern: Column) -> Column:
    """Array of (start, end, match), in code points, of the leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), m.alias("match")))

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: x["step"]), lambda x, y: x + y)
        return F.zip_with(parts, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match")))

    return let(parts, placed)


def without_emails(text: Column) -> Column:
    """text with a space for each character of its e-mail addresses; other entities have no letters."""
    pattern = F.lit(PATTERNS["email"])

    def blank(gaps: Column) -> Column:
        n = F.size(gaps) - 1
        filled = F.zip_with(F.slice(gaps, 1, n), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.concat(g, F.repeat(F.lit(" "), F.length(m))))
        return F.concat(F.array_join(filled, ""), F.get(gaps, n))

    return F.when(F.contains(text, F.lit("@")), let(F.split(text, pattern, -1), blank)).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """text with [KIND] for each of spans (start, end, kind); of spans that overlap, the first one's kind for all."""

    def cut(codes: Column, at: Column, upto: Column) -> Column:
        return F.decode(F.substring(codes, at * 4 + 1, (upto - at) * 4), "UTF-32")

    def joined(s: Column, ends: Column, codes: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        said = F.transform(s, lambda x, i: F.when(x["start"] >= before(i), F.concat(cut(codes, before(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(said, ""), cut(codes, F.get(ends, F.size(ends) - 1), F.length(text)))

    def of(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        return let(ends, lambda e: let(F.encode(text, "UTF-32"), lambda codes: joined(s, e, codes)))  # four bytes a code point

    return F.when(F.size(spans) == 0, text).otherwise(let(F.sort_array(spans), of))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda m: F.forall(F.split(m["match"], r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return lambda m: _luhn(F.translate(m["match"], " -", ""))
    if kind == "phone":
        return lambda m: F.length(F.regexp_replace(m["match"], "[^0-9]+", "")).between(8, 15)
    return lambda m: F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of (start, end, match) of the valid matches in text (not null)."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)")
    out = {}
    for kind in KINDS:
        gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
        out[kind] = F.when(gate, F.filter(find_spans(text, F.lit(PATTERNS[kind])), _valid(kind))).otherwise(none)
    return out


def terms_of(text: Column) -> Column:
    """The different lower-cased runs of letters outside e-mail addresses; other entities have no letters."""
    return F.array_distinct(F.filter(F.split(F.lower(without_emails(text)), r"\P{L}+"), lambda w: w != ""))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def _kinds(*kinds: str) -> Column:
    """The spans in the columns kinds, with their kind."""
    return F.concat(*(F.transform(k, _of_kind(k)) for k in kinds))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), id, digest of the text, base spans, hashes of the entities, the terms, and the digest of
    the text without the base spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    slim = [F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).cast(SPAN).alias(k) for k in KINDS]
    entities = F.array_distinct(F.transform(F.concat(*KINDS), lambda m: F.xxhash64(m["match"])))
    clean = F.unhex(F.sha2(redacted(F.col("text"), _kinds(*KINDS)).cast("binary"), 256))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "digest", *slim, entities.alias("entities"), terms_of(F.col("text")).alias("terms"), clean.alias("clean"))


def different_texts(found: DataFrame) -> DataFrame:
    """One measured row of each text."""
    first = durable(found.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    return found.join(first, "digest", "left").where("first is null or row = first").drop("first")


def disclosing_terms(texts: DataFrame, support: int, certainty: float, bits: float) -> DataFrame:
    """(term, n_te, n_t, p, pmi) of the terms that disclose an entity or a kind. texts: measured rows, one of each text."""
    has = {k: (F.size(k) > 0).cast("int") for k in KINDS} | {"some": (F.size("entities") > 0).cast("int")}
    n, *of_kind = texts.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(has[k]), F.lit(0)) for k in KINDS)).first()
    terms = texts.select(F.explode("terms").alias("term"), *(c.alias(k) for k, c in has.items()))
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"), *(F.sum(k).alias(k) for k in has))
    # A term stands with any entity at least as often as with the one it discloses, so this drops no such term.
    terms = durable(terms.where((F.col("some") >= support) & (F.col("some") >= F.col("n_t") * certainty)))
    each = F.explode(F.array(*(F.struct(F.col(k).alias("n_te"), F.lit(n_e).cast("long").alias("n_e")) for k, n_e in zip(KINDS, of_kind, strict=True)))).alias("x")
    pairs = terms.select("term", "n_t", each).select("term", "n_t", "x.n_te", "x.n_e")
    held = texts.where(F.size("entities") > 0)
    often = durable(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support))
    if not often.isEmpty():
        small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
        those = held.select("row", F.explode("entities").alias("entity")).join(small(often), "entity")
        words = held.select("row", F.explode("terms").alias("term")).join(small(terms.select("term", "n_t")), "term")
        pairs = pairs.unionByName(words.join(those, "row").groupBy("entity", "term").agg(F.first("n_t").alias("n_t"), F.count(F.lit(1)).alias("n_te"), F.first("n_e").alias("n_e")).drop("entity"))
    q = F.col("n_e") / F.lit(float(max(n, 1)))
    scored = pairs.where(F.col("n_te") >= support).withColumn("p", F.col("n_te") / F.col("n_t"))
    scored = scored.withColumn("pmi", F.log2((F.col("n_te") + q) / (F.col("n_t") + 1) / q))
    told = scored.where((F.col("p") >= certainty) & (F.col("pmi") >= -F.log2(q) * certainty) & (F.col("n_te") * F.col("pmi") >= bits))
    return durable(told.groupBy("term").agg(F.max("n_te").alias("n_te"), F.max("n_t").alias("n_t"), F.max("p").alias("p"), F.max("pmi").alias("pmi")))


def term_spans(docs: DataFrame, terms: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """(digest, term, text) for the texts with disclosing terms: the spans of these, and the text."""
    told = F.broadcast(terms.select("term")) if terms.count() <= BROADCAST_ROWS else terms.select("term")
    there = texts.select("digest", F.explode("terms").alias("term")).join(told, "term").groupBy("digest").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    there = durable(there)
    there = F.broadcast(there) if there.count() <= BROADCAST_ROWS else there
    rows = rows.join(there, "digest").dropDuplicates(["digest"])
    # One pattern for all terms of a text: terms are letters only.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    spans = F.transform(find_spans(without_emails(F.col("text")), pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).cast(SPAN)
    return rows.select("digest", spans.alias("term"), "text")


def pii_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, certainty: float = 0.8, bits: float = 6.0
) -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans, clean_sha256.

    clean_sha256 is the digest of the text that sanitise gives: base spans and disclosing terms are generalised to their
    kind. A null text counts as empty: no spans. Equal rows give equal rows; null ids stay null; other columns are
    ignored; no rows give no rows. Terms are sought outside e-mail addresses, so no span of a term overlaps a base span.
    """
    found = durable(measured(docs, id_col, text_col))
    texts = different_texts(found)
    terms = disclosing_terms(texts, support, certainty, bits)
    rows = found.select("id", "digest", *KINDS, "clean")
    none = F.expr(f"cast(array() as {SPAN})")
    if terms.isEmpty():
        rows = rows.withColumn("term", none)
    else:
        told = term_spans(docs, terms, texts, text_col).join(texts.select("digest", *KINDS), "digest")
        again = F.unhex(F.sha2(redacted(F.col("text"), _kinds(*KINDS, "term")).cast("binary"), 256))
        told = told.select("digest", "term", again.alias("again"))
        rows = rows.join(told, "digest", "left").withColumns({"term": F.coalesce("term", none), "clean": F.coalesce("again", "clean")})
    said = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.concat(*map(said, KINDS))
    return rows.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, said("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        F.size(F.concat(*KINDS, "term")).cast("long").alias("n_spans"),
        F.lower(F.hex("clean")).alias("clean_sha256"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, text) with base spans replaced by [KIND] and disclosing terms by [TERM]; ids have to be unique."""
    spans = pii_spans(docs, id_col, text_col, **options).select(F.col(id_col).alias("__id"), "spans").where("spans <> ''")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(spans, F.col(id_col) == F.col("__id"), "left")

    def parsed(s: Column) -> Column:
        return let(F.split(s, ":"), lambda x: F.struct(F.get(x, F.lit(1)).cast("int").alias("start"), F.get(x, F.lit(2)).cast("int").alias("end"), F.get(x, F.lit(0)).alias("kind")))

    each = F.transform(F.split("spans", ","), parsed)
    return rows.select(id_col, F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), each)).alias("text"))
