import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from edge import awkward, classes, nothing, repeated
from skytables.llm import common, fingerprints, jaccard_join, suffix_dedup


def synthetic(seed, n=300):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    bases = [[random.choice(vocabulary) for _ in range(random.choice([1, 2, 4, 5, 6, 8, 12, 18, 25, 90, 300]))] for _ in range(30)]
    shared = [random.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        b = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 5])):
            k = random.randrange(len(b))
            b[k:k + random.choice([0, 1])] = [random.choice(vocabulary)]
        texts.append(" ".join(b + shared * (random.random() < 0.3)))
    return texts


def test_components(spark):
    texts = [*synthetic(5), "", None, " \t"]
    got = {r.doc_id: r.component_id for r in jaccard_join.with_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(classes(texts)))


def test_components_of_many_near_copies_and_a_common_passage(spark):
    random.seed(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(random.randint(0, 5)):
            t[random.randrange(120)] = f"e{random.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join([f"u{i}-{j}" for j in range(80)] + base[:40]) for i in range(150)]
    got = {r.doc_id: r.component_id for r in jaccard_join.with_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(classes(texts)))


def test_components_of_signatures_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    texts = synthetic(6, 200)
    got = {r.doc_id: r.component_id for r in jaccard_join.with_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(classes(texts)))


def test_sketches_never_overstate_a_difference():
    """Sketches differ in no more bits than the sets in shingles, also of sets whose sketches have other widths."""
    rng = np.random.default_rng(4)
    for size in [1, 5, 80, 90, 300, 345, 1400, 9000]:
        for cut in [0, 0.1, 0.25, 0.6]:
            union = rng.integers(0, 2**64, size, dtype=np.uint64)
            a, b = np.sort(union[:max(1, round(size * (1 - cut)))]), np.sort(union[round(size * cut / 2):])
            x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
            bits = 8 * min(len(x), len(y))
            differ = int(np.bitwise_count(jaccard_join.folded([x], bits) ^ jaccard_join.folded([y], bits)).sum())
            assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


@pytest.mark.parametrize("rows_a_batch", [1, 2, 7, 1000])
def test_members_of_signatures_over_many_batches(rows_a_batch):
    """Members once each, signatures of one member left out, and equal lists for equal members, wherever batches end."""
    rng = np.random.default_rng(5)
    rows = sorted((int(s), int(g), 9, 3) for s, g in rng.integers(0, 12, (90, 2))) + [(50, 1, 9, 3), (51, 4, 9, 3), (51, 5, 9, 3), (52, 4, 9, 3), (52, 5, 9, 3), (52, 5, 9, 3)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    batches = [jaccard_join._columns(rows[at:at + rows_a_batch], types, ["sig", "gid", "n", "own"]) for at in range(0, len(rows), rows_a_batch)]
    out = [tuple(r.values()) for b in jaccard_join._met(iter(batches)) for r in b.to_pylist()]
    groups = {}
    for sig, gid, *_ in rows:
        groups.setdefault(sig, set()).add(gid)
    want = {sig: gids for sig, gids in groups.items() if len(gids) > 1}
    members = [(r[0], r[1]) for r in out if r[4] is None]
    assert sorted(members) == sorted((sig, gid) for sig, gids in want.items() for gid in gids)
    lists = {r[0]: (r[1], r[4], r[2]) for r in out if r[4] is not None}
    assert {sig: count for sig, (_, _, count) in lists.items()} == {sig: len(gids) for sig, gids in want.items()}
    assert all((lists[s] == lists[t]) == (want[s] == want[t]) for s in want for t in want)


@pytest.mark.parametrize("rows_a_batch", [1, 3, 1000])
def test_pairs_of_groups_over_many_batches(rows_a_batch):
    """Pairs of other classes that reach the threshold are all there; none is of one class or of one block of two."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 120, dtype=np.uint64)
    sets = {g: np.unique(np.concatenate((rng.choice(base, 110, replace=False), rng.integers(0, 2**64, int(rng.integers(0, 60)), dtype=np.uint64)))) for g in range(40)}
    rows = sorted((int(rng.integers(0, 3)), 0, int(rng.integers(0, 2)), g % 7, int(rng.integers(0, 2)), g, len(t), 5, 2, jaccard_join.sketch(t)) for g, t in sets.items())
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    batches = [jaccard_join._columns(rows[at:at + rows_a_batch], types, jaccard_join._OPEN) for at in range(0, len(rows), rows_a_batch)]
    got = {(r["a"], r["b"]) for b in jaccard_join._across(iter(batches)) for r in b.to_pylist()}
    may = {(min(x[5], y[5]), max(x[5], y[5])) for x in rows for y in rows if x[:3] == y[:3] and x[3] != y[3] and (x[1] == x[2] or x[4] != y[4])}
    link = {(a, b) for a, b in may if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert link and link <= got <= may and len(got) < len(may)


def test_segments_guarantee_a_meeting():
    """Any two sets that link share a signature, whatever their sizes."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 60, 100, 250, 257, 300, 1000, 4100]:
        for _ in range(20):
            union = rng.integers(0, 2**64, size, dtype=np.uint64)
            out = (25 * size) // 100
            cut = rng.integers(0, out + 1)
            a, b = np.sort(union[:size - cut]), np.sort(union[out - cut:])
            if not len(a) or not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            x, y = ({band: entry for (band, _), entry in zip(jaccard_join.bands_of(len(s)), jaccard_join.index_entries(s, None))} for s in (a, b))
            band = jaccard_join.bands_of(max(len(a), len(b)))[0][0]
            assert len(np.intersect1d(x[band][0], y[band][0])) >= jaccard_join.shared_at_least(len(a), x[band][1], len(b), y[band][1])


def test_only_texts_of_pairs_are_shuffled(spark, capsys):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = [f"b{i}" for i in range(100)]
        rows = spark.createDataFrame([(-g, 7 * g, " ".join(base[g:] if g < 9 else [f"x{g}"])) for g in range(50)], "_id long, _hash long, text string")
        where = rows.selectExpr("-_id as gid", "_id", "_hash")
        links = jaccard_join._verified(spark.createDataFrame([(1, 0), (2, 0), (3, 2), (9, 0), (10, 2)], "a long, b long"), where, rows)
        links.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(tuple(r) for r in links.collect()) == [(1, 0), (2, 0), (3, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_batches_of_texts_are_read_and_sent_in_few_rows(spark):
    settings = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    old = {s: spark.conf.get(s) for s in settings}
    try:
        for rows, want in ((20_000, common.TEXTS_A_BATCH), (7, 7)):
            for s in settings:
                spark.conf.set(s, str(rows))
            common.text_batches(spark.range(1))
            assert [int(spark.conf.get(s)) for s in settings] == [want, want]
    finally:
        for s in settings:
            spark.conf.set(s, old[s])


def test_near_duplicates_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = jaccard_join.with_components(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = classes([t for _, t in texts])
    with_words = {g for g, (_, t) in zip(groups, texts) if (t or "").strip()}
    assert kept.where("trim(text) <> '' and text is not null and text <> ' \\t\\n'").count() == len(with_words)
    assert kept.where("text is null").count() == 1
    assert jaccard_join.with_components(nothing(spark)).count() == 0


def test_suffix_array_and_prefixes():
    random.seed(1)
    for _ in range(150):
        text = bytes(random.choice(b"ab\0") for _ in range(random.randint(1, 60)))
        order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lengths = suffix_dedup.common_prefixes(np.frombuffer(text, np.uint8), order, 20, strips=7)
        for k in range(1, len(text)):
            a, b = text[order[k - 1]:], text[order[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lengths[k] == min(same, 20)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_repeats(spark, shard_bytes):
    random.seed(2)
    passages = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(5, 90))) for _ in range(12)]
    texts = []
    for _ in range(150):
        if random.random() < 0.2:
            texts.append(random.choice(["ab", "a", "éa"]) * random.randint(0, 60))
        else:
            texts.append("".join(random.choice(passages) if random.random() < 0.3 else "".join(random.choice("abcdefgh ") for _ in range(random.randint(1, 40))) for _ in range(random.randint(0, 9))))
    texts += texts[:15]
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    got = {r._doc.n: bytes(r._kept) for r in suffix_dedup.remove_repeats(docs, limit=40, gram=8, shard_bytes=shard_bytes).collect()}
    coded = [t.encode() for t in texts]
    want = {i: bytes(np.frombuffer(t, np.uint8)[np.frombuffer(m, np.uint8) == 0]) for i, (t, m) in enumerate(zip(coded, repeated(coded, 40)))}
    assert got == want


def test_repeats_on_awkward_rows(spark):
    docs = awkward(spark)
    got = suffix_dedup.deduplicated(docs, size="n_chars")
    assert got.schema.names == docs.schema.names and got.count() == docs.count()
    coded = [(r.text or "").encode() for r in docs.select("text").collect()]
    left = sorted(bytes(np.frombuffer(t, np.uint8)[np.frombuffer(m, np.uint8) == 0]).decode("utf-8", "ignore") for t, m in zip(coded, repeated(coded, 400)))
    assert sorted(r.text or "" for r in got.collect()) == left
    assert got.where("n_chars <> length(text)").count() == 0
    assert suffix_dedup.deduplicated(nothing(spark)).count() == 0


def brute_edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        out[k] = t[:len(t) - half] + nxt[:half]
    return out


@pytest.mark.parametrize("ids", [range(60), [0], [i * i * 1000 for i in range(60)], [-5, 7]])
def test_edited_texts(spark, ids):
    texts = [None, "", "é" * 7, *synthetic(9, 57)][:len(ids)]
    rows = list(zip(ids, texts))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.edited for k, r in got.items()} == brute_edited(rows)


def test_sketch_estimates_and_merges(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(4000)) for p in "ab")
    df = spark.createDataFrame([(a, a + " " + b, b)], "a string, ab string, b string")
    for c in ("a", "ab", "b"):
        df = fingerprints.with_sketch(df, c, f"s_{c}")
    r = df.select("s_a", "s_ab", "s_b", fingerprints.likeness("s_a", "s_ab").alias("near"), fingerprints.containment("s_a", "s_ab").alias("inside")).first()
    assert abs(r.near - 0.5) < 0.06 and r.inside == 1.0
    assert len(set(r.s_ab) - set(r.s_a) - set(r.s_b)) <= 4 and set(r.s_a) | set(r.s_b) <= set(r.s_ab)


def test_fingerprints_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = fingerprints.edited_fingerprints(docs).select("doc_id", "text", fingerprints.as_text("sketch").alias("f"), fingerprints.likeness("sketch", "edited_sketch").alias("x")).collect()
    assert len(rows) == docs.count() and all(0 <= r.x <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.f)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_fingerprints(nothing(spark)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == fingerprints.edited_fingerprints(docs.where("text = ''")).selectExpr("sha2(edited, 256) as s").first().s
