import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge import awkward, nothing, words
from skytables.llm import language_id, quality_rules, sentence_pieces, url_filter

DATA = "/root/testdata/sf0.001"


def brute_counts(text):
    text = text or ""
    found = words(text)
    places = {}
    for i in range(len(found) - 7):
        places.setdefault(tuple(found[i:i + 8]), []).append(i)
    marked = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("text", ["", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x " * 30, "é\nß é\n\né\né", "#a $b\x0bc|d\xa0e\n#a"])
def test_counts(text):
    assert tuple(quality_rules.features(text.encode())[:5]) == brute_counts(text)


def test_rules_on_awkward_rows(spark):
    rows = quality_rules.judge(quality_rules.with_features(awkward(spark).select("doc_id", "text"))).collect()
    assert len(rows) == awkward(spark).count()
    for r in rows:
        assert (r._rule_n_words, r._rule_word_chars, r._rule_n_symbols, r._rule_n_dup_lines, r._rule_n_repeat_words) == brute_counts(r.text)
        failed = r._rule_n_words < 20 or 100 * r._rule_n_repeat_words > 30 * r._rule_n_words
        assert r._rule_base_failed == failed and not (failed and r._rule_kept)
    verdicts = {}
    for r in rows:
        verdicts.setdefault(r.text, set()).add(r._rule_kept)
    assert all(len(v) == 1 for v in verdicts.values())
    assert quality_rules.keep_good(awkward(spark)).columns == awkward(spark).columns
    assert quality_rules.keep_good(nothing(spark)).count() == 0


def test_votes_are_weighed():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.stack([np.where(rng.random(good.size) < 0.3, 0, np.where(good, np.where(rng.random(good.size) < 0.001, -1, 1), np.where(rng.random(good.size) < hit, -1, 1)))
                      for hit in (0.9, 0.8, 0.7, 0.6, 0.5)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality_rules.fit_votes(patterns, counts.astype(float))[inverse.reshape(-1)]
    assert ((posterior >= 0.5) == good).mean() > 0.98
    assert len(quality_rules.fit_votes(np.zeros((0, 3), int), np.zeros(0))) == 0


@pytest.mark.parametrize("false", [0.01, 0.02, 0.03, 0.05])
def test_false_votes_are_found_out(false):
    rng = np.random.default_rng(2)
    good = rng.random(50_000) < 0.85
    votes = np.stack([np.where(rng.random(good.size) < 0.2, 0, np.where(rng.random(good.size) < np.where(good, false, hit), -1, 1))
                      for hit in (0.9, 0.8, 0.7, 0.6, 0.5, 0.5, 0.4, 0.4)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    kept = (quality_rules.fit_votes(patterns, counts.astype(float)) >= 0.5)[inverse.reshape(-1)]
    assert (~kept[good]).mean() < 0.2 * (votes[good] < 0).any(1).mean() and (~kept[good]).mean() < 0.012
    assert kept[~good].mean() < 0.1


@pytest.mark.parametrize("text, upper, letters", [("aB1", 1, 2), ("ПРИвет ok", 3, 8), ("USA 日本語 ǅ²µ", 3, 8), ("éÉ!\xa0😀", 1, 2)])
def test_letters_of_all_scripts_count(text, upper, letters):
    counts = dict(zip(quality_rules.FEATURES, quality_rules.features(text.encode()), strict=True))
    assert (counts["n_upper"], counts["n_letters"]) == (upper, letters)


def test_capitals_in_another_script_are_no_shouting(spark):
    docs = spark.createDataFrame([(1, "тихий текст о США и NATO " * 9), (2, "ГРОМКИЙ ТЕКСТ " * 15)], "doc_id long, text string")
    rows = quality_rules.with_features(docs).select("doc_id", quality_rules.default_rules()["shouting"].alias("vote"))
    assert dict(map(tuple, rows.collect())) == {1: 0, 2: -1}


def test_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.judge(quality_rules.with_features(docs)).join(labels, "doc_id").where("not _rule_base_failed")
    found = Counter((r.quality, r._rule_kept) for r in kept.select("quality", "_rule_kept").collect())
    assert found[1, False] == 0 and found[0, True] <= 0.1 * (found[0, True] + found[0, False])


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs)).where(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.98 * len(found) > 100
    assert all(0 <= r.score <= 1 for r in found)


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 2000 and 4000 and crc32(cast(doc_id as string)) % 4 = 2").collect()}
    both = texts["en"][:1500] + " " + texts["de"][:1500]
    r = language_id.predict(spark.createDataFrame([(1, both)], "doc_id long, text string"), model).first()
    assert set(r.languages) == {"de", "en"} and 0.3 < r.score < 0.7


def test_language_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    empty = language_id.train(nothing(spark))
    assert empty.languages == [] and language_id.predict(nothing(spark), empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert not language_id.predict(docs.where("doc_id is null"), empty).where(language_id.held_out(F.col("doc_id"))).count()


def test_columns_of_any_name(spark):
    """Names that the operators use inside, or used once."""
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = spark.createDataFrame([(1, text, "x", 7, "k", "http://a.com/en/b")], "doc_id long, text string, _llm_text string, _rule_n_words long, _keys string, url string")
    model = language_id.Model([], np.zeros((0, language_id.BUCKETS)))
    assert language_id.predict(rows, model).first()._llm_text == "x"
    assert quality_rules.keep_good(rows).collect() == rows.collect()
    judged = quality_rules.judge(quality_rules.with_features(rows)).first()
    assert (judged._rule_n_words, judged._keys) == (len(words(text)), "k")
    pieces = sentence_pieces.encode_decode(rows, "/opt/tokenizers/piece_bpe_32k.model").first()
    assert (pieces._llm_text, pieces.decoded) == ("x", text)
    rule = spark.createDataFrame([("block", "com", "/en/")], "action string, host string, path string")
    page = url_filter.judge_urls(rows, rule).first()
    assert (page._keys, page.doc_id, page.rule, page.verdict) == ("k", 1, "com/en/", "block")
