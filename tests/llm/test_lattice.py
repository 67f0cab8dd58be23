"""Lattice scores against sums over all segmentations in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakecheck.llm import lattice
from lakecheck.llm.lattice import Lattice, fit, lattice_scores, word_logs
from lakecheck.llm.pieces import MARK, load
from lakecheck.llm.queries import QUERIES
from tests.llm.data import empty, table

SF = "/root/testdata/sf0.001"
PIECES = sorted(p for p in load().scores if not any("A" <= c <= "Z" for c in p))
KNOWN = set(PIECES)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text or ""))


def segmentations(weights, bare, word):
    """``(probability, pieces)`` of all ways to cut a word; None stands for a bare character."""
    if not word:
        yield 1.0, ()
        return
    for k in range(1, len(word) + 1):
        if word[:k] in weights:
            for p, rest in segmentations(weights, bare, word[k:]):
                yield weights[word[:k]] * p, (word[:k], *rest)
    for p, rest in segmentations(weights, bare, word[1:]):
        yield bare * p, (None, *rest)


def forward(weights, bare, word, longest=24):
    """Sum over all ways to cut a word, with exact powers of two kept aside."""
    cells, shift = [1.0], 0
    for stop in range(1, len(word) + 1):
        total = cells[-1] * bare
        for size in range(1, min(stop, longest) + 1):
            if word[stop - size : stop] in weights:
                total += cells[-size] * weights[word[stop - size : stop]]
        cells = [*cells[-longest:], total]
        if total < 1e-200:
            cells, shift = [c * 2.0**400 for c in cells], shift - 400
    return math.log(cells[-1]) + shift * math.log(2)


def weights_of(model):
    return {p: math.exp(v) for p, v in zip(PIECES, model.logs)}


def plain_fit(words, ends):
    """The model as plain numbers: expected counts by listing all segmentations."""
    prior = {p: math.exp(v) for p, v in load().scores.items() if p in KNOWN}
    whole = sum(prior.values())
    prior = {p: lattice.PRIOR * v / whole for p, v in prior.items()}
    counts, unknown, stops = dict.fromkeys(prior, 0.0), 0.0, 0
    for step in range(lattice.ROUNDS + 1):
        total = sum(counts.values()) + lattice.PRIOR + unknown + stops + 2
        weights = {p: (counts[p] + prior[p]) / total for p in prior}
        bare, end = (unknown + 1) / total / lattice.CODE_POINTS, (stops + 1) / total
        if step == lattice.ROUNDS:
            return weights, bare, end
        counts, unknown, stops = dict.fromkeys(prior, 0.0), 0.0, ends
        for word, n in words.items():
            ways = list(segmentations(weights, bare, MARK + word))
            whole = sum(p for p, _ in ways)
            for p, cut in ways:
                for piece in cut:
                    if piece is None:
                        unknown += n * p / whole
                    else:
                        counts[piece] += n * p / whole


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def test_weights_are_a_distribution_that_starts_from_the_vocabulary():
    model = Lattice.of()
    assert np.exp(model.logs).sum() + math.exp(model.unknown) + math.exp(model.end) == pytest.approx(1)
    scores = load().scores
    ratio = np.array([model.logs[PIECES.index(p)] - scores[p] for p in PIECES[::997]])
    assert np.ptp(ratio) < 1e-9


def test_word_logs_sum_all_segmentations():
    model = Lattice.of()
    weights, bare = weights_of(model), math.exp(model.bare)
    words = ["the", "nation", "a", "▁", "▁▁x", "日本語", "🙂é", "thethenation", "12ab", "zzzzzzz", "distribution"]
    got = word_logs(model, pa.array(words))
    for word, log in zip(words, got):
        assert log == pytest.approx(math.log(sum(p for p, _ in segmentations(weights, bare, MARK + word))), rel=1e-12)
        assert log == pytest.approx(forward(weights, bare, MARK + word), rel=1e-12)


def test_long_words_are_summed_whole(monkeypatch):
    model = Lattice.of()
    weights, bare = weights_of(model), math.exp(model.bare)
    rng = random.Random(1)
    words = ["".join(rng.choice("thenatio▁日é") for _ in range(n)) for n in (3, 40, 300, 1500, 5000)]
    want = [forward(weights, bare, MARK + w) for w in words]
    assert word_logs(model, pa.array(words)) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(lattice, "BLOCK", 64)
    assert word_logs(model, pa.array(words)) == pytest.approx(want, rel=1e-12)


def test_fitted_weights_against_listed_segmentations(spark):
    words = {"the": 9, "nation": 4, "thenat": 2, "日本": 3, "a": 1, "zq": 5}
    types = spark.createDataFrame([*words.items(), ("unseen", 0)], "word string, c long").repartition(3)
    model = fit(types, 7)
    weights, bare, end = plain_fit(words, 7)
    assert math.exp(model.end) == pytest.approx(end) and math.exp(model.bare) == pytest.approx(bare)
    got = weights_of(model)
    assert all(got[p] == pytest.approx(weights[p]) for p in PIECES)


def check(rows, got, model=None):
    """All columns but ``score`` against plain code; ``score`` too if the model is given."""
    train, ends = Counter(), 0
    for key, text in rows:
        if not held(key):
            train.update(words_of(text))
            ends += 1
    total, distinct = sum(train.values()) + ends, len(train) + (ends > 0)
    smooth = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    want = []
    for key, text in rows:
        words = words_of(text)
        base = sum(smooth(train[w]) for w in words) + smooth(ends)
        row = [key, held(key), len(words) + 1, sum(train[w] > 0 for w in words) + (ends > 0), total, base]
        if model:
            weights, bare, end = model
            row.append((sum(forward(weights, bare, MARK + w) for w in words) + math.log(end)) / math.log(10))
        want.append(row)
    key = lambda r: (r[0] is None, str(r[0]), r[2], round(r[5], 3))
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for mine, plain in zip(got, sorted(want, key=key)):
        assert mine[:5] == tuple(plain[:5])
        assert mine[5 : len(plain)] == pytest.approx(plain[5:], rel=1e-9)


@pytest.mark.parametrize("known", [0, 40, 1 << 17])
def test_odd_rows(spark, known):
    docs = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = Counter(w for key, text in rows if not held(key) for w in words_of(text))
    types = spark.createDataFrame(list(train.items()), "word string, c long")
    model = fit(types, sum(not held(key) for key, _ in rows))
    got = lattice_scores(docs, known=known)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    check(rows, got.collect(), (weights_of(model), math.exp(model.bare), math.exp(model.end)))


def test_empty_table_and_nothing_to_learn_from(spark):
    assert lattice_scores(empty(spark)).count() == 0
    only = next(i for i in range(99) if held(i))
    rows = [(only, "the nation"), (only, "the nation")]
    got = lattice_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got[0] == got[1] and got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0 and got[0]["n_tokens"] == 3
    assert got[0]["score"] < 0 and got[0]["base_score"] == 0


def test_a_very_long_text(spark):
    rows = [(1, "some words and more of them " * 100_000 + "unbroken" * 60_000), (2, "some words"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice_scores(docs).collect()}
    check(rows, got.values())
    assert got[1]["score"] < -1e5 and all(math.isfinite(r["score"]) for r in got.values())


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_lm_scores"](spark, SF).collect()
    check(rows, got)
    # the fitted pieces tell texts of the corpus from noise, on texts that nothing was learned from
    prose = [r["score"] / r["n_tokens"] for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert len(prose) > 10 and min(prose) > -20
