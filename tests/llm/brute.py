"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, n_tokens string, kept string"


def table(spark, rows):
    """rows: (doc_id, text) -> documents with further columns, some of whose names operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", None, "y") for i, t in rows], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "a b c d e f g h i j " * 3), (7, "a b c d e f g h i j " * 3),
    (8, "wort " * 5000), (9, "é ü ñ 日本語 " * 30), (10, "x" * 30_000), (7, "a b c d e f g h i j " * 3), (None, "no id here at all"), (11, None),
]


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def components(rows, width, percent):
    """doc_id -> (set size, smallest linked id)."""
    sets, lists, above = {i: shingles(t, width) for i, t in rows}, defaultdict(list), {}

    def top(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for a, b in {(a, b) for x in lists.values() for a in x for b in x if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = top(a), top(b)
            if p != q:
                above[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def spans(text):
    valid = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid[k](m[0])]
