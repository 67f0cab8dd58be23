"""Chats, mixing, repeats, near duplicates, languages and pieces against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecheck.llm import chat, components, language, mixing, repeats, setsketch, viterbi
from lakecheck.llm.pieces import MARK, load
from tests.llm.data import empty, ordered, plain, rows, table, words


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- chats --------------------------------------------------------------------------------------

TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|> \<\\s> [\INST]", "", "plain", "<", "<|im_end|", "é🙂 <s>", "x" * 5000]


def chats(spark):
    rng = random.Random(3)
    out = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\n", "</s>"]), rng.choice(TRICKY)) for c in range(40) for t in range(rng.randrange(1, 9))]
    out += [(1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (None, 2, "user", None), (None, 1, None, "x"), (2, None, "assistant", "first")]
    out += [(99, t, ("user", "assistant")[t % 2], f"turn {t} " + "long text " * 60) for t in range(9000)]
    return out, spark.createDataFrame(out, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))


def test_chats_are_read_back(spark):
    data, df = chats(spark)
    parts = chat.format_chats(df)
    got = chat.read_back(parts)
    turns = defaultdict(list)
    for conv, turn, role, text in data:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = []
    for conv, of in turns.items():
        of.sort()
        loss = "".join(t for *_, r, t in of if r == "assistant")
        want.append((conv, len(of), sha("".join(f"{r}\n{t}\n" for *_, r, t in of)), len(loss), sha(loss)))
    assert plain(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == ordered(want)
    assert parts.where("conv_id = 99").count() > 1  # a long conversation has several parts
    for r in parts.where("conv_id < 40").collect():
        for turn in r["formatted"].split(chat.CLOSE)[:-1]:
            assert turn.startswith(chat.OPEN)
            assert not re.search(r"</?s>|\[/?INST\]|<\|im_(start|end)\|>", turn.removeprefix(chat.OPEN))


def test_chats_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(none)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_targets(seed):
    rng = random.Random(seed)
    size = {f"s{i}": rng.choice([0, 1, 10, 500, 10_000]) for i in range(rng.randrange(1, 9))}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(size)}
    target = mixing.fill_targets(size, weight, sum(size.values()))
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    open_ = {s for s in size if target[s] < 3 * size[s] - 1e-9}
    assert all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    assert len({round(target[s] / weight[s], 6) for s in open_}) <= 1  # the rest share by weight
    assert not open_ or all(target[s] / weight[s] <= min(target[o] / weight[o] for o in open_) + 1e-6 for s in size)


def test_flow_prefers_unread_words_and_shares_overlaps():
    p = [mixing.Pattern("a", ("a",), 100), mixing.Pattern("ab", ("a", "b"), 100), mixing.Pattern("b", ("b",), 10)]
    flow = mixing.route(p, {"a": 150, "b": 60})
    given = Counter()
    for (i, _), n in flow.items():
        given[i] += n
    assert sum(given.values()) == 210 and all(given[i] <= p[i].words for i in given)  # nothing is repeated
    assert sum(n for (i, s), n in flow.items() if s == "b") == 60
    flow = mixing.route(p[2:], {"b": 1000})
    assert flow == {(0, "b"): 30}  # at most three passes


@pytest.mark.parametrize("seed", range(40))
def test_flows_are_maximal_and_cheapest(seed):
    rng = random.Random(seed)
    names = [None, "a", "b", "c", "d"][: rng.randrange(1, 6)]
    sets = sorted({tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)), key=str)) for _ in range(rng.randrange(1, 8))}, key=str)
    p = [mixing.Pattern(str(x), x, rng.randrange(0, 30)) for x in sets]
    quotas = {s: rng.randrange(0, 60) for s in names}
    flow = mixing.route(p, quotas)
    given, got = Counter(), Counter()
    for (i, s), n in flow.items():
        assert n > 0 and s in p[i].sources
        given[i] += n
        got[s] += n
    assert all(got[s] <= quotas[s] for s in names) and all(given[i] <= 3 * p[i].words for i in given)
    cuts = [{s for k, s in enumerate(names) if m >> k & 1} for m in range(2 ** len(names))]
    largest = [min(sum(quotas[s] for s in t) + sum(k * x.words for x in p if not t.issuperset(x.sources)) for t in cuts) for k in range(4)]
    assert sum(given.values()) == largest[3]
    cost = sum(k * max(0, min(p[i].words, n - k * p[i].words)) for i, n in given.items() for k in range(3))
    assert cost == sum(k * (largest[k + 1] - largest[k]) for k in range(3))


def test_very_many_sources_are_routed():
    n = 100_000
    alone = [mixing.Pattern(str(i), (str(i),), i % 100) for i in range(n)]
    assert sum(mixing.route(alone, {str(i): 150 for i in range(n)}).values()) == sum(min(150, 3 * (i % 100)) for i in range(n))
    ring = [mixing.Pattern(str(i), (str(i), str((i + 1) % 5000)), 10) for i in range(5000)]
    assert sum(mixing.route(ring, {str(i): 25 for i in range(5000)}).values()) == 125_000


def test_mixed_sizes(spark):
    got = mixing.mixed_sizes(table(spark)).collect()
    assert len(got) == len(rows())
    size = Counter()
    for r in rows():
        size[r[3]] += len(re.findall(r"[^ \x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    target = mixing.fill_targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(size.values()))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in size)
    assert ordered(map(tuple, got)) == ordered(map(tuple, mixing.mixed_sizes(table(spark).repartition(5)).collect()))
    assert mixing.mixed_sizes(empty(spark)).count() == 0


def test_mixed_rows_agree_with_the_sizes(spark):
    df = table(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    counted = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mixed_sizes(df).where("size > 0").collect():
        assert counted.get(r["doc_id"], 0) * r["size"] == r["taken"]


# ---- repeats ------------------------------------------------------------------------------------


def test_marks_are_common_prefixes():
    rng = np.random.default_rng(1)
    for least in (1, 3, 8, 40):
        lengths = rng.integers(1, 60, 12)
        parts = [bytes(rng.integers(97, 97 + 3, n).astype(np.uint8)) for n in lengths] + [b"ab" * 40, b"ab" * 41, b"a" * 70, bytes(range(256))]
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.uint16)
        for p, e in zip(parts, ends):
            text[e - len(p) : e] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
        order = repeats.suffix_order(text, ends)
        suffixes = [p[i:] + b"" for p in parts for i in range(len(p) + 1)]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        marks = repeats.common_prefix_marks(text, order, least)
        for i in range(1, len(order)):
            a, b = suffixes[order[i - 1]], suffixes[order[i]]
            assert marks[i] == (a[:least] != b[:least] or len(a) < least or len(b) < least)


def cut(data):
    first = {}
    raw = [(math.inf if i is None else i, (t or "").encode(), i) for i, t in data]
    for i, b, _ in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], math.inf), i)
    for i, b, own in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield own, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)


@pytest.mark.parametrize("chunk_bytes", [3_000, 4 << 20])
def test_repeats(spark, chunk_bytes):
    got = repeats.cut_repeats(table(spark), chunk_bytes=chunk_bytes)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("starts").alias("n_spans"), "kept_sha256", (F.aggregate("ends", F.lit(0).cast("long"), lambda a, x: a + x) - F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("covered"))
    want = ordered(cut([(r[0], r[1]) for r in rows()]))
    assert sum(w[2] for w in want) > 5000
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(r["covered"] == r["n_removed"] for r in got.collect())
    assert repeats.cut_repeats(empty(spark)).count() == 0


def test_repeats_of_random_texts(spark):
    rng = random.Random(9)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randrange(30, 120))) for _ in range(30)]
    data = [(i, "".join(rng.choice(stock) for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    got = repeats.cut_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4), chunk_bytes=5_000)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("starts").alias("n_spans"), "kept_sha256")
    assert plain(got, *got.columns) == ordered(cut(data))


# ---- near duplicates ----------------------------------------------------------------------------


def near(data):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for i, text in data:
        w = re.findall(r"[^ \x09-\x0D]+", (text or "").translate(lower))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            ids[root(k)].append(i)
    for k, (i, s) in enumerate(sets):
        least = min(ids[root(k)], default=None) if s else i
        yield i, len(s), least, i == least


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_groups(spark):
    got = setsketch.near_groups(table(spark))
    assert plain(got, *COLUMNS) == ordered(near([(r[0], r[1]) for r in rows()]))
    assert setsketch.near_groups(empty(spark)).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    rng = random.Random(4)
    data = []
    for family in range(2):
        base = words(rng, 90, 5000)
        for _ in range(110):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            data.append((len(data), " ".join(copy)))
    rng.shuffle(data)
    got = setsketch.near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    want = list(near(data))
    assert 2 <= len({w[2] for w in want}) < 150
    assert plain(got, *COLUMNS) == ordered(want)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    for common, only_a, only_b in ((300, 0, 0), (300, 50, 50), (300, 100, 0), (200, 200, 200), (10, 500, 500), (1500, 100, 400)):
        errors = []
        for _ in range(20):
            x = rng.integers(0, 2**63, common + only_a + only_b, dtype=np.uint64)
            a, b = x[: common + only_a], np.concatenate((x[:common], x[common + only_a :]))
            j = setsketch.estimated(*(setsketch.registers(s)[None] for s in (a, b)), np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(j - common / len(x))
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.17


def test_registers_of_a_union_are_maxima():
    x = np.random.default_rng(3).integers(0, 2**63, 300, dtype=np.uint64)
    assert (setsketch.registers(x) == np.maximum(setsketch.registers(x[:100]), setsketch.registers(x[90:]))).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 7)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(35)]
    up = {n: n for e in edges for n in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    inner = {n for a, b in edges if a != b for n in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert plain(got, "node", "label") == ordered((n, root(n)) for n in inner)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- languages ----------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return language.train_on(spark.read.parquet(f"{SF}/documents.parquet"), per_language=60)


def test_languages_of_texts_never_seen(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = language.predict(docs, model).where(language.held_out())
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.95
    assert told.where("score < 0 or score > 1").count() == 0


def test_all_segmentations_are_summed(model):
    place = {int(p): i for i, p in enumerate(model.pieces)}
    known = sorted({p.lower() for p in load().ids if p == MARK or p.strip(MARK)})
    prob = {p: model.probs[place[i]] for i, p in enumerate(known)}

    def total(word):
        if not word:
            return np.ones(len(model.languages))
        out = sum(prob[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in prob)
        return out + (language.UNKNOWN * total(word[1:]) if word[0] not in prob else 0)

    tested = ["the", "unter", "ciónes", "x", "été", "zz日q"]
    assert np.allclose(language.word_scores(model, tested), [np.log(total(MARK + w)) for w in tested])
    rng = random.Random(10)
    longest = max(prob, key=len).removeprefix(MARK)
    tested = ["ab" * 40, "x" * 31, "x" * 32, "日" * 47, "日" * 48, "日" * 500, longest, longest * 9, "\x00" * 40, "straightforward" * 30]
    tested += ["".join(rng.choice(("the", "distribution", "é", "日", "z", longest)) for _ in range(rng.randrange(8, 200))) for _ in range(30)]
    assert np.allclose(language.word_scores(model, tested), [forward(model, prob, MARK + w) for w in tested], rtol=1e-9)


def forward(model, prob, word):
    """Log probability of the whole word over all segmentations, in log space."""
    alpha, longest = [np.zeros(len(model.languages))], max(map(len, prob))
    for stop in range(1, len(word) + 1):
        ways = [alpha[a] + np.log(prob[word[a:stop]]) for a in range(max(0, stop - longest), stop) if word[a:stop] in prob]
        if word[stop - 1] not in prob:
            ways.append(alpha[stop - 1] + np.log(language.UNKNOWN))
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_languages_of_odd_texts(spark, model):
    docs = table(spark)
    got = language.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    want = [(r[0], r[5], "und" if not re.search(r"[^\W\d_]", r[1] or "") else None) for r in rows()]
    told = [(r["doc_id"], r["node"], "und" if r["lang_pred"] == "und" else None) for r in got.collect()]
    assert ordered(told) == ordered(want)
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.train_on(empty(spark))
    assert nothing is None and {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_models_learn_from_all_labelled_texts(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(language, "written", lambda df, name: tables.setdefault(name, df.localCheckpoint()))
    docs = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("The word"), F.col("id"), F.lit(" the\tthe ")).alias("text"))
    language.train(docs, rounds=1)
    got = {(r["lang"], r["word"]): r["n"] for r in tables["words"].collect()}
    want = {(lang, "the"): 6000 for lang in "ab"} | {("ab"[i % 2], f"word{i}"): 1 for i in range(4000)}
    assert got == want


def test_floors_come_from_all_labelled_rows(spark):
    rng = np.random.default_rng(4)
    mean, weight = -2 - rng.random(6000), rng.random(6000)
    mean[:12] = -9.5  # two rows in a thousand, the rarer the sample the less of them
    weight[:12] = 1
    data = [(i, "en" if i else None, "en", (float(m), float(w))) for i, (m, w) in enumerate(zip(mean, weight))] + [(-1, "de", "de", (-3.0, 1.0)), (-2, "de", "und", None)]
    told = spark.createDataFrame(data, "doc_id long, lang string, lang_pred string, fit struct<mean: double, weight: double>").repartition(5)
    usual = np.median(mean[1:])
    far = np.quantile((usual - mean[1:]) * weight[1:], 0.999)
    floors = language.fit_floors(told)
    assert floors["en"] == pytest.approx((usual, -2 * far), abs=3e-4) and far > 6
    assert floors["de"] == (-3.0, -1.0) and set(floors) == {"en", "de"}
    assert language.fit_floors(told.where("lang is null")) == {}


def test_expected_counts_follow_all_segmentations(model):
    place = {int(p): i for i, p in enumerate(model.pieces)}
    known = sorted({p.lower() for p in load().ids if p == MARK or p.strip(MARK)})
    where = {p: place[i] for i, p in enumerate(known)}

    def ways(word):
        if not word:
            yield 1.0, []
        for k in range(1, len(word) + 1):
            if word[:k] in where or k == 1:
                p = where.get(word[:k])
                for rest, pieces in ways(word[k:]):
                    yield (language.UNKNOWN if p is None else model.probs[p]) * rest, [*pieces, *([] if p is None else [p])]

    tested, want = ["the", "x", "zz日q", "日", "été", "unter"], np.zeros_like(model.probs)
    for i, word in enumerate(tested):
        lang, found = i % len(model.languages), list(ways(MARK + word))
        total = sum(prob[lang] if np.ndim(prob) else prob for prob, _ in found)
        for prob, pieces in found:
            for p in pieces:
                want[p, lang] += (i + 1) * prob[lang] / total
    got = np.zeros_like(want)
    for cps, lengths, word in language.units(tested):
        got += model.expected(cps, lengths, word % len(model.languages), word + 1.0)
    assert np.allclose(got, want)


# ---- pieces -------------------------------------------------------------------------------------


def test_segmentations_are_the_best_ones():
    v = load()
    s = viterbi.Segmenter(v)
    rng = random.Random(6)
    tested = ["▁" + "".join(rng.choice("therinsgaoéß日▁") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["▁the", "▁there", "▁therein", "\nthe", "\n▁x"]
    s.learn(tested)
    score = {i: v.scores[p] for p, i in v.ids.items()} | dict.fromkeys(v.bytes_, viterbi.BYTE_SCORE)
    for word in tested:
        least = 1 if word[0] == "\n" else 0
        best = [-math.inf] * len(word) + [0.0]
        best[len(word)] = 0.0
        for at in range(len(word) - 1, least - 1, -1):
            best[at] = viterbi.BYTE_SCORE * len(word[at].encode()) + best[at + 1]
            for stop in range(at + 1, len(word) + 1):
                piece = word[at:stop]
                if piece in v.scores and MARK not in piece[1:] and (at == 0 or piece[0] != MARK):
                    best[at] = max(best[at], v.scores[piece] + best[stop])
        assert sum(score[i] for i in s.known[word]) == pytest.approx(best[least])


def test_runs_of_blanks_use_their_pieces():
    v = load()
    s = viterbi.Segmenter(v)
    rng = random.Random(8)
    tested = ["".join(rng.choice(("the", "a", " ", "  ", "   ", "\n", MARK, "é")) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    tested += [" " * n for n in range(1, 40)] + [" " * 5 + "the", "the" + " " * 7, "a\n" + " " * 4 + "b", "\n", " \n ", MARK * 3, " " + MARK]
    score = {i: v.scores[p] for p, i in v.ids.items()} | dict.fromkeys(v.bytes_, viterbi.BYTE_SCORE)
    for text, got in zip(tested, s.encode(tested)):
        whole = " " + text  # the best segmentation of the text as a whole; only blanks are marks
        best = [0.0] * (len(whole) + 1)
        for at in range(len(whole) - 1, -1, -1):
            best[at] = best[at + 1] + viterbi.BYTE_SCORE * len(whole[at].encode())
            for stop in range(at + 1, min(len(whole), at + v.longest) + 1):
                part = whole[at:stop]
                if MARK not in part and part.replace(" ", MARK) in v.scores:
                    best[at] = max(best[at], v.scores[part.replace(" ", MARK)] + best[stop])
        assert sum(score[i] for i in got) == pytest.approx(best[0])
    assert len(s.encode([" " * 15])[0]) == 1


def test_a_long_text_is_encoded_by_stretches():
    v = load()
    rng = random.Random(9)
    long = "".join(rng.choice(("the ", "cat", "  ", "\n", "é ", " on\n  ")) for _ in range(1_500_000))
    got, lengths = viterbi.Segmenter(v).pieces(pa.array(["the", long, None, ""]))
    parts = ["".join(x) for x in (long[i : i + 1000] for i in range(0, 3000, 1000))]
    few = viterbi.Segmenter(v).encode(["the", long[:3000], "".join(parts)])
    assert got[: lengths[0]].tolist() == few[0] and few[1] == few[2]
    assert list(lengths[2:]) == [0, 0] and lengths.sum() == len(got)
    table = {i: p.replace(MARK, " ").encode() for p, i in v.ids.items()} | {i: bytes([b]) for b, i in enumerate(v.bytes_)}
    assert b"".join(map(table.__getitem__, got[lengths[0] :].tolist())).decode() == " " + long
    assert got[lengths[0] : lengths[0] + 600].tolist() == few[1][:600]


def test_texts_come_back_exactly(spark):
    docs = table(spark)
    back = viterbi.decode(viterbi.encode(docs)).collect()
    assert ordered((r["doc_id"], r["text"], r["node"]) for r in back) == ordered((r[0], r[1], r[5]) for r in rows())
    assert all(r["decoded"] == r["text"] and (r["tokens"] is None) == (r["text"] is None) for r in back)
    assert viterbi.decode(viterbi.encode(empty(spark))).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    v, t = load(), ["the cat sat\non the mat", "a  b", "the the"]
    want = viterbi.Segmenter(v).encode(t)
    monkeypatch.setattr(viterbi, "KNOWN_WORDS", 2)
    s = viterbi.Segmenter(v)
    assert [s.encode([x])[0] for x in t] == want


def test_arrow_slices_cover_all_rows():
    from lakecheck.llm.arrow import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 3_000_000, 1, 0, 2_000_000, 7)] + [None]})
    got = [x for s in slices(batch.slice(1), "text") for x in s.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()[1:]
