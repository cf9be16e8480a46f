"""A small documents table with everything that may go wrong in one, and brute-force helpers."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size int, part int"


def prose(seed: int, n: int) -> str:
    """Sentences of invented words, the same for a seed."""
    x, words = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        word = "".join("bcdfglmnprst"[(x >> s) % 12] + "aeiou"[(x >> (s + 3)) % 5] for s in (4, 9, 15)[: 1 + x % 3])
        words.append(word + ("." if i % 12 == 11 else ""))
    return " ".join(words)


def rows():
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (3, near, "a"), (4, None, "a"), (5, "", None), (6, " \n\t ", "b"),
        (7, "one two", "a"), (None, prose(2, 90), None), (8, prose(3, 30000), "c"), (9, "x" * 9000, "c"),
        (10, "\n".join(["Home | News | Sport | Contact", prose(4, 70) + ".", "All rights reserved.", prose(4, 70) + "."]), "d"),
        (11, "!!! ### $$$\n" + prose(5, 60), "é"), (12, "same same same " * 40, "d"), (13, prose(6, 200) + "\n" + base, "b"),
    ]
    return [(i, t, "en" if t else None, s, len(t) if t else None, "r", None, 7, i) for i, t, s in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def shingles(text, width=5):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)
