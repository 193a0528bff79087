"""Tables with every awkward case, and small brute-force versions shared by the tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, _id string, _hash long, _doc string, kept boolean, label string, score double"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(15_000))
PASSAGE = "".join(f"passage {i} repeats itself across texts, " for i in range(20))


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names."""
    texts = [
        None, "", " \t\n", "a", "A", "é", "12 34 !!", LONG, LONG + " tail", "the same text here " * 8, "the same text here " * 8,
        PASSAGE + "one", "two " + PASSAGE, "Guten Tag und auf Wiedersehen " * 6, "x" * 5000, "日本語 のテキスト", "one two three four five six",
        "one two three four five seven",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], "src0", None if t is None else len(t), "x", 5, "d", i % 2 == 0, None, 0.5) for i, t in enumerate(texts)]
    rows += [rows[7], rows[9], (None, "no id at all " * 9, None, None, None, None, None, None, None, None, None)]
    other = "another text under a known id " * 5
    rows += [(None, "no id at all " * 9, None, None, None, None, None, None, None, None, None), (9, other, "en", "src0", len(other), *rows[9][5:])]
    return spark.createDataFrame(rows, KIND)


def nothing(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return WORD.findall(text or "")


def as_set(text):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4)))


def classes(texts):
    """Index of the first text of each text's class of near duplicates."""
    sets, parent = [as_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def repeated(texts, limit):
    """For each text (bytes), which bytes strings of `limit` bytes cover that start more than once."""
    from collections import Counter

    times = Counter(t[i:i + limit] for t in texts for i in range(len(t) - limit + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - limit + 1):
            if times[t[i:i + limit]] > 1:
                marks[i:i + limit] = b"\1" * limit
        out.append(marks)
    return out
