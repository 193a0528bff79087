"""Ranked search, license scans and vector codes against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from edge import awkward, nothing
from skytables.llm import license_scans, ranked_search, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- ranked search -------------------------------------------------------------------------

def scores_of(docs, queries, k):
    """Every document against every query: (query, rank, doc_id, score)."""
    terms = [Counter(TERM.findall(lower(t))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    held = Counter(t for c in terms for t in c)
    out = []
    for q, text in queries:
        found = []
        for (doc, _), c, size in zip(docs, terms, sizes, strict=True):
            score = 0
            for t, times in Counter(TERM.findall(lower(text))).items():
                if c[t]:
                    m = 25 + 75 * size * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(q, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, queries, **options):
    return sorted((tuple(r) for r in ranked_search.search(docs, queries, **options).collect()), key=repr)


@pytest.mark.parametrize("chunk", [7, 16_384])
def test_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ä", "ä", "naïve", "x9"]
    common = [w for i, w in enumerate(words) for _ in range(60 // (i + 1))] + words
    docs = [(i, " ".join(rng.choices(common, k=rng.choice([0, 1, 5, 40, 300])))) for i in rng.sample(range(1000), 120)]
    docs += [(5000, docs[3][1]), (5001, docs[3][1]), (5002, None), (5003, "W1, w1;W2-ä"), (5004, "...  w1")]
    queries = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 80])))) for i in range(25)] + [(90, None), (91, "!"), (92, "unheard"), (93, "w1 " * 9)]
    try:
        got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "item_id long, text string"), k=6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == scores_of(docs, queries, 6)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(50)]
    queries = [(i, f"a{i} b{i % 3} c c") for i in range(9)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "QUERIES_AT_ONCE", 2)
    assert searched(*tables) == scores_of(docs, queries, 10)


def test_search_bears_anything(spark):
    docs = awkward(spark)
    queries = spark.createDataFrame([(1, "the same text"), (1, "passage 3"), (None, "é"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = scores_of(rows, [(r.item_id, r.text) for r in queries.collect()], 10)
    assert searched(docs, queries) == want
    assert searched(nothing(spark), queries) == searched(docs, queries.limit(0)) == []


# --- license scans -------------------------------------------------------------------------

def scanned(text, templates):
    words = TERM.findall(lower(text))
    starts = range(0, max(0, -(-(len(words) - license_scans.BLOCK) // license_scans.STRIDE)) * license_scans.STRIDE + 1, license_scans.STRIDE)
    places, met = [], []
    for t in templates:
        own = license_scans.words_of(t.text)
        if t.phrase:
            places += [(t.label, i) for i in range(len(words)) if words[i:i + len(own)] == own]
            continue
        for s in starts:
            share = len(set(words[s:s + license_scans.BLOCK]) & set(own)) / len(set(own))
            if 100 * len(set(words[s:s + license_scans.BLOCK]) & set(own)) >= license_scans.THRESHOLD * len(set(own)):
                met.append((t.label, s, share))
    return sorted(places), sorted(set(met))


def notices(seed):
    rng = random.Random(seed)
    sentences = [t.text for t in license_scans.PHRASES + license_scans.NOTICES]
    some = " ".join(sentences).split()
    for i in range(150):
        words = rng.choices(["plain", "Wörter", "the", "of", "x"], k=rng.choice([0, 3, 60, 400]))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            at = rng.randrange(len(words) + 1)
            new = rng.choice(sentences).split() if rng.random() < 0.7 else rng.choices(some, k=12)
            if rng.random() < 0.4:
                new[rng.randrange(len(new))] = "other"
            words[at:at] = [w.upper() if rng.random() < 0.3 else w for w in new]
        yield i, rng.choice([" ", "\n", ", "]).join(words)


def test_scan(spark):
    docs = [*notices(1), (900, None), (901, ""), (902, "CC\nby cc BY, cc-by cc.by"), (902, "CC\nby cc BY, cc-by cc.by"), (903, "all rights İ reserved ALL RIGHTS RESERVED "), (904, "cc by " * 3000)]
    templates = license_scans.PHRASES + license_scans.NOTICES
    rows = license_scans.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r._doc.doc_id, r.n_words, [tuple(p) for p in r.places], [tuple(m) for m in r.met]) for r in rows)
    want = sorted((i, len(TERM.findall(t or "")), *scanned(t, templates)) for i, t in docs)
    assert got == want
    assert any(m for *_, m in want) and any(0 < x[2] < 1 for *_, m in want for x in m)


def test_scan_bears_anything(spark):
    docs = awkward(spark).withColumnRenamed("kept", "words").withColumnRenamed("label", "_row")
    rows = license_scans.scan(docs)
    assert sorted(rows.select("_doc.*").columns) == sorted(set(docs.columns) - {"text"})
    out = rows.select(*license_scans.summary(rows)).collect()
    assert len(out) == docs.count() and all(r.labels == r.base_labels == "" and r.score == 0 and r.n_base == 0 and r.first_word is None for r in out)
    assert license_scans.scan(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        license_scans.scan(docs, [license_scans.Template("long", "word " * 99)])


# --- vector codes --------------------------------------------------------------------------

def codes_of(vectors, parts, entries, rounds, scale):
    """All distances in plain whole numbers; `vectors` are those kept, by id."""
    x = [[math.floor(scale * float(v)) for v in vec] for vec in vectors]
    w = len(x[0]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        dist = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        if r == rounds:
            return [[d[1] for d in row] for row in dist], [sum(d[0] for d in row) for row in dist], books
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, d in zip(cut, dist, strict=True) if d[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]


@pytest.mark.parametrize(("n", "entries", "spread"), [(300, 32, 1.0), (200, 16, 0.004), (40, 256, 1.0), (1, 256, 1.0), (90, 8, 1e-4), (60, 12, 2e4)])
def test_codes(spark, n, entries, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(7, 12)) * spread
    vectors = [[float(v) for v in centres[rng.integers(7)] + rng.normal(size=12) * spread * 0.3] for _ in range(n)]
    ids = [int(i) for i in rng.permutation(10 * n)[:n]]
    rows = list(zip(ids, vectors, [int(i) % 3 or None for i in ids], strict=True))
    odd = [(-1, None, 1), (-2, [1.0] * 11 + [None], 1), (-3, [1.0] * 11 + [math.inf], 2), (-4, [math.nan] * 12, None), (-5, [], 1), (-6, [1.0] * 11, 1)]
    more = [(10**6, [1.0] * 16, 1), (10**6 + 1, [1e30] * 12, 1), (10**6 + 2, vectors[0], 5), (10**6 + 2, vectors[0], 5), (None, vectors[-1], 5)]
    df = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<double>, label int").repartition(3)
    out, books = vector_codes.encode(df, parts=4, entries=entries, rounds=4)
    out = vector_codes.with_label_error(out)
    kept = sorted(rows, key=lambda r: r[0]) + more[2:]
    codes, errors, want_books = codes_of([r[1] for r in kept], 4, entries, 4, 1024)
    totals = Counter()
    for r, e in zip(kept, errors, strict=True):
        totals[r[2]] += e
    got = sorted(((r._doc.vec_id is None, r._doc.vec_id or 0), list(r._code), r._error, r._label_error) for r in out.collect())
    assert got == sorted(((r[0] is None, r[0] or 0), c, e, totals[r[2]]) for r, c, e in zip(kept, codes, errors, strict=True))
    assert books.tolist() == want_books


def test_bounds_decide_as_all_distances_do():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-60, 60, (500, 4)), rng.integers(-60, 60, (64, 4))
    part, deep = vector_codes.Part(x, book, 8), 0
    for b in (8, 8, 6, 3, 3, 1):
        new = book + rng.integers(-3, 4, book.shape) * (rng.random((64, 1)) < 0.5)
        part.moved(np.sqrt(((new - book) ** 2).sum(1)) * (1 + vector_codes.MARGIN))
        book = new
        part.assign(x, book)
        part.cut(b)
        dist = vector_codes.distances(x, book)
        assert (part.a == dist.argmin(1)).all()
        deep += np.count_nonzero(part.depth == 0)
        root = np.sqrt(dist)
        assert (part.upper >= root[np.arange(500), part.a]).all()
        assert (part.low <= np.take_along_axis(root, part.near, 1)).all()
        others = np.ones(dist.shape, bool)
        np.put_along_axis(others, np.concatenate([part.a[:, None], part.near], 1), False, 1)
        assert (part.outer[:, None] <= np.where(others, root, np.inf)).all()
    assert deep > 100  # bounds alone decided these


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "x")], "vec_id long, embedding array<float>, label string")
    for table in (df, df.limit(0)):
        out, books = vector_codes.encode(table)
        assert vector_codes.with_label_error(out).collect() == [] and books.size == 0
    clash = spark.createDataFrame([(i, [float(i)] * 4, 1, 2, 3) for i in range(9)], "vec_id long, embedding array<float>, label int, _x int, _id int")
    assert vector_codes.with_label_error(vector_codes.encode(clash)[0]).select("_doc.*").columns == clash.columns
