import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from edge import awkward, nothing
from skytables.llm import packing, sentence_pieces, token_files, url_filter, warc

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_stretches_equal_whole_texts():
    random.seed(3)
    bits = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "1", "23", ".", "!!", "日本", "\xa0", "\u200b", "<|endoftext|>", "\x1c", "don't", " 's", "\r\n", "’", "😀", "I'm"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.WordEncoder(BYTE_BPE).encode(texts)]
    assert got == library(texts)


def test_words_of_mixed_scripts_equal_whole_texts():
    random.seed(5)
    bits = ["a", "G", "ł", "μ", "µ", "ª", "Б", "日", "ع", "ก", "ḁ", "𝐀", "𠀀", "😀", "̈", "²", "Ⅷ", "٣", " ", "'", "'μ", "5", "-"]
    texts = ["take 5 μg daily", "5 μg", "5 µg", "aБв", "Ωmega", "日本go", "x²y"]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.WordEncoder(BYTE_BPE).encode(texts)]
    assert got == library(texts)


def test_every_cut_of_stretches_is_one_of_the_pre_tokenizer():
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(BYTE_BPE).pre_tokenizer.pre_tokenize_str
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        text = f"a{c}b"
        if not token_files.ODD.search(text):
            ends = np.cumsum([len(x) for x in token_files.STRETCH.findall(text)]).tolist()
            assert ends[-1] == len(text) and set(ends) <= {end for _, (_, end) in cut(text)}, text


def test_token_files_round_trip(spark, tmp_path):
    docs = awkward(spark)
    token_files.write_token_files(docs, str(tmp_path / "t"), BYTE_BPE, 2)
    rows = token_files.read_token_files(spark, str(tmp_path / "t"))
    read = sorted(rows.collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in read] == [k for k, _ in want]
    start, ids = 0, {t: i + [2] for t, i in zip([t for _, t in want], library([t for _, t in want]))}
    for r in read:
        assert r.start == start and r.n_tokens == len(r.tokens)
        start += r.n_tokens
    assert sorted(map(tuple, (r.tokens for r in read))) == sorted(tuple(ids[t]) for _, t in want)
    sums = {(r.start, r.ids_crc32) for r in token_files.with_crc32(rows).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) for r in read}
    part = next(p for p in sorted((tmp_path / "t").glob("*.parquet")) if pq.read_metadata(p).num_rows)
    column = pq.read_metadata(part).row_group(0).column(0)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index
    assert "tokens:array" not in rows.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    token_files.write_token_files(nothing(spark), str(tmp_path / "n"), BYTE_BPE, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "n")).count() == 0


def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/p?{i % 5}", f"<p>{i % 6}é</p>" * (1 if i % 2 else 300)) for i in range(40)]
    rows += [(40, None, None), (41, "no scheme", ""), (42, "http://a b/\n", "x\r\n\r\nWARC/1.1\r\n"), (None, "http://x/", "<p>1é</p>"), rows[3], (43, "http://long/", "y" * 300_000)]
    return spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, digest string, place long")


@pytest.mark.parametrize("least", [0, 100])
def test_archives(spark, least):
    table = pages(spark)
    read = warc.archive_and_read(table, with_payload=True, min_payload=least).collect()
    source = [(r.page_id, r.html or "") for r in table.collect()]
    assert len(read) == len(source)
    keeper = {}
    for k, t in source:
        if k is not None:
            keeper[t] = max(k, keeper.get(t, k))
    texts = {}
    for k, t in source:
        texts.setdefault(str(k) if k is not None else None, t)
    for r in read:
        t = texts[r.id]
        assert r.payload_bytes == len(t.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        alone = len(t.encode()) < least or [x for _, x in source].count(t) == 1 or r.id == str(keeper.get(t))
        assert (r.record_type, r.refers_to) == (("response", None) if alone else ("revisit", str(keeper[t])))
        assert r.payload == (t if alone else None)
    assert warc.archive_and_read(table.limit(0)).count() == 0


def test_index_is_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = warc.write_archives(pages(spark), str(tmp_path), captured=F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert runs.select("archive").distinct().count() > 1
    index = [(r.url_key, r.captured, r.id is not None, r.id) for r in warc.merge_runs(runs).orderBy("place").collect()]
    assert len(index) == pages(spark).count() and index == sorted(index, key=lambda r: (r[0], r[1], r[2], r[3] or ""))


def test_loser_tree():
    random.seed(4)
    for k in range(9):
        runs = [sorted(random.randrange(30) for _ in range(random.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def brute_rule(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    random.seed(6)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    rules += [(random.choice(["allow", "block"]), f"h{i}.org", f"/{'x' * (i % 3)}") for i in range(40)]
    urls = [None, "", "no", "://", "http://", "HTTP://WWW.Example.COM/en/?a://b", "http://com", "http://com/", "http://xcom/", "http://a.net/fr", "http://a.net/fr/#x", "x://é.net/es/\n"]
    urls += [f"http://{random.choice(['', 'a.', 'h1.'])}h{random.randrange(60)}.org/{'x' * random.randrange(4)}" for _ in range(500)] + ["http://h1.org/"] * 3
    table = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, key long")
    listed = spark.createDataFrame(rules, "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table, listed).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(table.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(table, listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(universe.where("key % 17 = 0"), universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 17 == 0)).count() == 0


def best_score(pieces, text):
    """Greatest score over all segmentations, by plain dynamic programming over characters."""
    known = {t: s for t, s in pieces.items()}
    least = min(known.values()) - sentence_pieces.UNKNOWN_PENALTY
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in known:
                best[j] = max(best[j], best[i] + known[text[i:j]])
        if text[i] not in known:
            best[i + 1] = max(best[i + 1], best[i] + least)
    return best[-1]


def test_best_path():
    import sentencepiece

    loaded, model = sentence_pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {model.id_to_piece(int(i)): float(loaded.scores[i]) for i in loaded.ordinary}
    texts = ["thonre inthe wherever", "a  b   c ", " lead", "日本語 ∀x∃", "\n\ttab", "élève œuvre", "x" * 60, "don't stop-me"]
    byte = {int(i) for i in loaded.byte_ids}
    for text, coded in zip(texts, loaded.encode(texts)):
        ids = np.frombuffer(coded, "<u4").tolist()
        assert loaded.decode(np.array(ids)) == text
        got = sum(loaded.scores[i] for i in ids if i not in byte)
        unknown = sum(1 for c in sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK) if c not in scores)
        want = best_score(scores, sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK))
        assert abs(got + unknown * float(loaded.least) - want) < 1e-3 * abs(want)


def test_trie_finds_all_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"bca"]
    trie = sentence_pieces.DoubleArray(keys)
    text = b"abcab\xff\x00bcab"
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    start, end, number = trie.matches(data, np.arange(len(text)), np.full(len(text), len(text)))
    got = {(s, e, keys[n]) for s, e, n in zip(start.tolist(), end.tolist(), number.tolist())}
    assert got == {(i, i + len(k), k) for i in range(len(text)) for k in keys if text[i:i + len(k)] == k}


def test_pieces_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = sentence_pieces.encode_decode(docs, PIECES).collect()
    assert len(rows) == docs.count() and all(r.decoded == (r.text or "") for r in rows)
    assert all((len(r.piece_ids) == 0) == (not r.text) for r in rows)
    assert sentence_pieces.encode_decode(nothing(spark), PIECES).count() == 0


def test_packing_holds(spark):
    rng = np.random.default_rng(8)
    lengths = np.concatenate((rng.integers(0, 900, 4000), [8192, 4096, 1024, 1024, 0, 0]))
    bins, place, capacity = packing.pack(lengths)
    fills = np.bincount(bins, weights=lengths)
    assert fills.max() <= 8192 and lengths.sum() / np.bincount(bins, minlength=len(fills)).astype(bool).sum() > 0
    for k in range(len(fills)):
        mine = np.flatnonzero(bins == k)
        order = mine[np.argsort(place[mine], kind="stable")]
        assert (np.cumsum(lengths[order]) - lengths[order] == place[order]).all()
        assert set(capacity[mine]) == {min(c for c in packing.CAPACITIES if c >= fills[k])}
    used = {k: capacity[bins == k][0] for k in range(len(fills))}
    assert lengths.sum() / sum(used.values()) > 0.97


def test_opened_length_fits_what_is_to_come():
    lengths = np.random.default_rng(9).integers(2800, 3001, 2000)  # two of them leave 2,192 of 8,192 free at least
    bins, _, capacity = packing.pack(lengths, (3000, 8192), 16)
    assert len(set(bins.tolist())) == 2000 and set(capacity.tolist()) == {3000}
    small = np.concatenate((lengths, np.full(2000, 2000)))  # these fill the rest of 8,192
    assert 8192 in set(packing.pack(small, (3000, 8192), 16)[2].tolist())
    assert packing.fill(10, [0, 1, 0, 0, 2], 0b10010) == 9 and packing.fill(3, [5], 1) == 0 and packing.fill(0, [1, 1], 3) == 0


def test_packing_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = packing.best_fit(docs, F.length("text")).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence, []).append(r)
    for mine in by_sequence.values():
        assert sum(r.length for r in mine) <= mine[0].capacity
    assert sum(r.length for r in rows) == docs.selectExpr("sum(length(text)) as n").first().n
    assert packing.best_fit(nothing(spark), F.length("text")).count() == 0


def test_unknown_words_are_encoded_as_lines_of_one_text(monkeypatch):
    """The tokenizer gets a text for every LINES unknown words, not one for each; the ids are those of whole texts."""
    encoder = token_files.WordEncoder(BYTE_BPE)
    texts = [" ".join(f"{a}{b}q{n}, {b}x{a}'s" for a in "abcdefgh" for b in "tuvw") + f"\n\n {n}\n\t end. don't  stop\n" for n in ("me", "日本", "é'll", "\x00", "<|endoftext|>")]
    want = [array("I", x.ids).tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    given, plain = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda some: given.extend(some) or plain(some))
    assert encoder.encode(texts) == want and len(encoder.known) > 130
    assert len(given) < 30
    given.clear()
    assert encoder.encode(texts) == want and sorted(given) == sorted(texts[3:])
