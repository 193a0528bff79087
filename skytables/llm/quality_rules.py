"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule votes keep (1) or reject (-1), or abstains (0). A document is good or
bad, unseen; given that, rules vote independently, each with accuracies of its own
for good and for bad documents. These and the share of good documents are
estimated from the votes of all documents, without labels. The posterior
probability of good replaces "all rules must pass".

The estimate needs only how often each combination of votes occurs, at most
3 ** rules numbers, so the corpus is counted once by a partial aggregation and the
iterations run over that small table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import as_bytes, column_of, saved, slices, text_batches, whole_row

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8
#: What is believed of a rule before any vote is seen, in votes on good documents: of PRIOR_VOTES and as many
#: again as PRIOR_SHARE of the documents, the share PRIOR_FALSE is false. Votes of the corpus outweigh it.
PRIOR_VOTES, PRIOR_SHARE, PRIOR_FALSE = 1000, 0.01, 0.01
#: No better than chance.
CHANCE = 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_distinct", "n_stutters"]
_PREFIX = "_rule_"


def n_repeated(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank, size = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), 1
    while size < window:  # ranks of windows twice as long, from pairs of ranks
        step = min(size, window - size)
        left, right = rank[:-step], rank[step:]
        rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)[1].reshape(-1)
        size += step
    often = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def features(text: bytes) -> list[int]:
    """The counts named in FEATURES, of one whole text."""
    words = text.split()  # of bytes: at ASCII white space only
    lines = [x for x in text.split(b"\n") if x.split()]
    chars = sum(map(len, words)) - len(text.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    letters = upper + len(text) - len(text.translate(None, bytes(range(97, 123))))
    if not text.isascii():
        others = [c for c in text.translate(None, bytes(range(128))).decode(errors="replace") if c.isalpha()]
        upper, letters = upper + sum(map(str.isupper, others)), letters + len(others)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [
        len(words), chars, symbols, len(lines) - len(set(lines)), n_repeated(words), len(lines),
        upper, letters, text.count(b"!"), len(set(words)), sum(map(eq, words, words[1:])),
    ]


def with_features(docs: DataFrame, text: str | tuple[str, ...] = "text") -> DataFrame:
    """`docs` with the counts of FEATURES, as `_rule_<name>`; existing columns that begin so are dropped.

    Null text has none of anything; a very long text is counted whole, at a cost in
    proportion to its length. `text` names a text column, or as a tuple one within a struct.
    """
    text_batches(docs)
    docs = docs.drop(*[c for c in docs.columns if c.startswith(_PREFIX)])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(_PREFIX + name, T.LongType()) for name in FEATURES)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([features(x) for x in as_bytes(column_of(batch, text))], np.int64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=schema.names)

    return docs.mapInArrow(count, schema)


def _f(name: str) -> Column:
    return F.col(_PREFIX + name)


def _vote(reject: Column, keep: Column) -> Column:
    return F.when(reject, -1).when(keep, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes by rule name, over the counts of `with_features`."""
    words, letters = F.greatest(_f("n_words"), F.lit(1)), F.greatest(_f("n_letters"), F.lit(1))
    long_enough = _f("n_words") >= 50
    return {
        "symbols": _vote(_f("n_symbols") > 0.1 * words, _f("n_symbols") < 0.02 * words),
        "shouting": _vote(_f("n_upper") > 0.5 * letters, _f("n_upper") < 0.2 * letters),
        "exclamations": _vote(_f("n_shouts") > 0.2 * words, _f("n_shouts") < 0.02 * words),
        "repetition": _vote(_f("n_repeat_words") > 0.25 * words, (_f("n_repeat_words") < 0.05 * words) & long_enough),
        "stutter": _vote(_f("n_stutters") > 0.2 * words, _f("n_stutters") < 0.05 * words),
        "lines": _vote((_f("n_dup_lines") > 0.3 * _f("n_lines")) & (_f("n_lines") >= 4), (_f("n_dup_lines") == 0) & (_f("n_lines") >= 2)),
        "variety": _vote((_f("n_distinct") < 0.1 * words) & long_enough, _f("n_distinct") > 0.3 * words),
        "word_length": _vote((_f("word_chars") > 14 * words) | (_f("word_chars") < 2 * words), _f("word_chars").between(3 * words, 10 * words)),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 1.0) -> np.ndarray:
    """Posterior probability of good for each combination of votes, by expectation-maximisation.

    Starts from "a document that some rule rejects is bad"; `prior` is added to every
    count. Rules count as better than chance: a vote on a good document is to keep it
    at least half of the time, and no less often than on a bad one. This fixes which of
    the two classes is the good one. How often a vote on a good document is false is
    estimated, from PRIOR_FALSE on: where bad documents are rejected by a single rule
    each, votes alone cannot tell them from good ones that it rejects falsely. A
    combination without any vote gets the share of good documents.
    """
    if not len(counts):
        return np.zeros(0)
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    voted = patterns != 0
    keeps = patterns > 0
    believed = PRIOR_VOTES + PRIOR_SHARE * counts.sum()
    for _ in range(rounds):
        score = []
        least = None
        for share in (good, 1 - good):
            w = (counts * share)[:, None]
            n = believed if least is None else 0
            right = ((w * keeps).sum(0) + prior + (1 - PRIOR_FALSE) * n) / ((w * voted).sum(0) + 2 * prior + n)
            right = np.maximum(right, CHANCE) if least is None else np.minimum(right, least)
            least = right
            log = np.where(voted, np.where(keeps, np.log(right), np.log1p(-right)), 0).sum(1)
            score.append(log + np.log(((counts * share).sum() + prior) / (counts.sum() + 2 * prior)))
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good


def judge(rows: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """`rows` of `with_features` with `_rule_base_failed`, `_rule_posterior` and `_rule_kept`.

    The base check fails below 20 words, or where more than 30 in 100 words stand in
    repeated windows; such documents are not kept whatever the posterior. Empty and
    null texts fail it. Equal texts get equal verdicts; an empty table gives no row.
    Rows are written once to the shared folder, as the estimate and the verdict both
    need them.
    """
    rules = default_rules() if rules is None else rules
    failed = (_f("n_words") < 20) | (100 * _f("n_repeat_words") > 30 * _f("n_words"))
    votes = F.array(*[v.cast("tinyint") for v in rules.values()])
    rows = saved(rows.withColumns({_PREFIX + "base_failed": failed, _PREFIX + "votes": votes}), "quality-votes")
    # Those that fail the base check are decided, and would only blur the estimate. At most 3 ** rules rows.
    passing = F.sum(F.when(_f("base_failed"), 0).otherwise(1)).alias("n")
    found = rows.groupBy(_PREFIX + "votes").agg(passing).collect()
    found.sort(key=lambda r: r[0])
    patterns = np.array([r[0] for r in found], np.int64).reshape(len(found), len(rules))
    good = fit_votes(patterns, np.array([r[1] for r in found], float))
    pairs = itertools.chain.from_iterable((F.lit(",".join(map(str, p))), F.lit(float(g))) for p, g in zip(patterns.tolist(), good, strict=True))
    known = F.create_map(*pairs) if found else F.create_map(F.lit(""), F.lit(0.0))
    pattern = F.array_join(F.transform(_PREFIX + "votes", lambda v: v.cast("string")), ",")
    rows = rows.withColumn(_PREFIX + "posterior", F.element_at(known, pattern))
    return rows.withColumn(_PREFIX + "kept", ~_f("base_failed") & (_f("posterior") >= threshold)).drop(_PREFIX + "votes")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(with_features(docs.select(whole_row(docs)), ("_doc", text))).where(_f("kept")).select("_doc.*")
