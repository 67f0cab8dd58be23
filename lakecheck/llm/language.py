"""Language identification: unigram piece models that sum over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A text is split at white space;
the probability of a marked word is the sum over all ways to cut it into pieces, worked out by the forward
algorithm, and the log probabilities of its words add up. Models are trained by expectation maximisation: expected
piece counts over all segmentations of the words of all labelled texts, gathered per language and piece.

The work per row is over distinct words: words of a slice are hashed, and the forward algorithm runs over columns
of distinct words, position by position, for all languages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.arrow import ragged, slices, text_buffer
from lakecheck.llm.pieces import MARK, VOCABULARY, load
from lakecheck.llm.storage import written
from lakecheck.llm.words import mix, powers, word_hashes, word_spans

ROUNDS = 3
#: Added to each expected count.
SMOOTHING = 0.05
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-6
#: Characters of a word up to which it is scored in one block; training alone cuts longer runs into units of so many.
UNIT = 32
#: Positions of a longer word that are worked out between two rescalings, and words that go together.
STRIDE = 16
TOGETHER = 1024
KNOWN_WORDS = 400_000
#: Characters from which on the mean score of a text is taken as it is.
FIT_CHARS = 100
#: Bytes of text whose words are counted together in training, before they are shuffled.
COUNT_BYTES = 1 << 22
#: Leading bits of a piece's hash by which most parts of words that are no piece are told.
SEEN_BITS = 20
#: Decimals of a log score per character in the thresholds: scores are counted on this grid, all of them.
FIT_DIGITS = 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _spans_hash(sums: np.ndarray, start, stop) -> np.ndarray:
    return mix((sums[:, stop] - sums[:, start]) * powers(_INVERSE, UNIT + 1)[start] + np.uint64(stop - start))


def piece_keys(pieces: list[str]) -> np.ndarray:
    """The hash under which each piece is found inside a unit."""
    cps = np.zeros((len(pieces), max(map(len, pieces))), np.uint32)
    for i, p in enumerate(pieces):
        cps[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
    sums = _prefix_sums(cps)
    lengths = np.array([len(p) for p in pieces])
    out = np.empty(len(pieces), np.uint64)
    for n in np.unique(lengths):
        out[lengths == n] = _spans_hash(sums[lengths == n], 0, int(n))
    return out


def _prefix_sums(cps: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(cps), cps.shape[1] + 1), np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + np.uint64(1)) * powers(_BASE, cps.shape[1])[: cps.shape[1]], axis=1, out=sums[:, 1:])
    return sums


@dataclass
class Model:
    """``keys``: sorted hashes of the pieces; ``pieces``: their number in the vocabulary; ``probs``: piece by language; ``longest``: characters of a piece."""

    languages: list[str]
    keys: np.ndarray
    pieces: np.ndarray
    probs: np.ndarray
    longest: int

    @cached_property
    def seen(self) -> np.ndarray:
        """Whether a piece has a hash with these leading bits."""
        out = np.zeros(1 << SEEN_BITS, bool)
        out[self.keys >> np.uint64(64 - SEEN_BITS)] = True
        return out

    def hits(self, sums: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose ``[start, stop)`` is a piece, and the places of these pieces."""
        keys = _spans_hash(sums, start, stop)
        rows = np.flatnonzero(self.seen[keys >> np.uint64(64 - SEEN_BITS)])
        keys = keys[rows]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        met = self.keys[at] == keys
        return rows[met], at[met]

    def forward(self, cps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward scores (unit, position, language); rows by falling length."""
        sums, n = _prefix_sums(cps), len(self.languages)
        alpha = np.zeros((len(cps), cps.shape[1] + 1, n))
        alpha[:, 0] = 1.0
        for stop in range(1, cps.shape[1] + 1):
            live = int(np.searchsorted(-lengths, -stop, side="right"))
            for start in range(max(0, stop - self.longest), stop):
                rows, at = self.hits(sums[:live], start, stop)
                if stop - start == 1 and len(rows) < live:
                    bare = np.setdiff1d(np.arange(live), rows, assume_unique=True)
                    alpha[bare, stop] += alpha[bare, start] * UNKNOWN
                if len(rows):
                    alpha[rows, stop] += alpha[rows, start] * self.probs[at]
        return alpha

    def log_scores(self, cps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        alpha = self.forward(cps, lengths)
        return np.log(alpha[np.arange(len(cps)), lengths])

    def expected(self, cps: np.ndarray, lengths: np.ndarray, lang: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts (piece, language) over all segmentations; a unit counts ``weights`` times, in its own language alone."""
        sums = _prefix_sums(cps)
        alpha = np.zeros((cps.shape[1] + 1, len(cps)))
        alpha[0] = 1.0
        met = []  # pieces, and characters that no piece covers, by stop
        for stop in range(1, cps.shape[1] + 1):
            live = int(np.searchsorted(-lengths, -stop, side="right"))
            for start in range(max(0, stop - self.longest), stop):
                rows, at = self.hits(sums[:live], start, stop)
                if stop - start == 1 and len(rows) < live:
                    bare = np.setdiff1d(np.arange(live), rows, assume_unique=True)
                    alpha[stop, bare] += alpha[start, bare] * UNKNOWN
                    met.append((bare, start, stop, None, UNKNOWN))
                if len(rows):
                    p = self.probs[at, lang[rows]]
                    alpha[stop, rows] += alpha[start, rows] * p
                    met.append((rows, start, stop, at, p))
        ends = np.arange(len(cps))
        total = alpha[lengths, ends]
        beta = np.zeros_like(alpha)
        beta[lengths, ends] = weights / total
        cells, counts = [np.empty(0, np.int64)], [np.empty(0)]
        for rows, start, stop, at, p in reversed(met):
            back = beta[stop, rows] * p
            beta[start, rows] += back
            if at is not None:
                cells.append(at * len(self.languages) + lang[rows])
                counts.append(alpha[start, rows] * back)
        return np.bincount(np.concatenate(cells), np.concatenate(counts), self.probs.size).reshape(self.probs.shape)


def units(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(code points, lengths, word)``: marked words, cut into units, by falling length, padded within a block."""
    text = "".join(MARK + w for w in words)
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parts = -(-sizes // UNIT)
    word = np.repeat(np.arange(len(words)), parts)
    k = ragged(np.zeros(len(words), np.int64), parts)
    start, length = begin[word] + k * UNIT, np.minimum(UNIT, sizes[word] - k * UNIT)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), 16384):
        rows = order[at : at + 16384]
        grid = np.zeros((len(rows), int(length[rows[0]])), np.uint32)
        flat = ragged(start[rows], length[rows])
        grid[np.repeat(np.arange(len(rows)), length[rows]), ragged(np.zeros(len(rows), np.int64), length[rows])] = cps[flat]
        yield grid, length[rows], word[rows]


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log probability of each word, its mark included, in each language, over all segmentations of the whole word."""
    out = np.zeros((len(words), len(model.languages)))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    short, long = np.flatnonzero(sizes <= UNIT), np.flatnonzero(sizes > UNIT)
    if len(short):
        for cps, lengths, word in units([words[i] for i in short]):
            out[short[word]] = model.log_scores(cps, lengths)
    long = long[np.argsort(-sizes[long], kind="stable")]
    for at in range(0, len(long), TOGETHER):
        rows = long[at : at + TOGETHER]
        out[rows] = long_scores(model, [words[i] for i in rows])
    return out


def long_scores(model: Model, words: list[str]) -> np.ndarray:
    """``word_scores`` of words by falling length, ``STRIDE`` positions of all of them at a time.

    The forward scores of the last ``longest`` positions go on to the next stride, divided by the one of the last
    position, whose logarithm is added up: nothing is cut, and nothing gets too small however long a word is.
    """
    text = "".join(MARK + w for w in words)
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin, wide, n = np.cumsum(sizes) - sizes, model.longest, len(model.languages)
    probs = np.vstack((model.probs, np.zeros(n), np.full(n, UNKNOWN)))
    absent, unknown = len(model.keys), len(model.keys) + 1
    out, logs = np.empty((len(words), n)), np.zeros((len(words), n))
    tail = np.zeros((len(words), wide, n))
    tail[:, -1] = 1.0
    stops = wide + np.arange(STRIDE)  # in a window that starts wide - 1 characters before the stride
    starts = stops[:, None] - np.arange(wide, 0, -1)
    shift, length = powers(_INVERSE, UNIT + 1)[starts], (stops[:, None] - starts).astype(np.uint64)
    for done in range(0, int(sizes[0]), STRIDE):
        live = int(np.searchsorted(-sizes, -done, side="left"))  # words of more than ``done`` characters
        at = done - wide + 1 + np.arange(wide - 1 + STRIDE)
        inside = (at >= 0) & (at < sizes[:live, None])
        window = np.where(inside, cps[np.where(inside, begin[:live, None] + at, 0)], 0)  # no piece has the character 0
        sums = _prefix_sums(window)
        keys = mix((sums[:, stops][:, :, None] - sums[:, starts]) * shift + length)
        place = np.searchsorted(model.keys, keys)
        place[place == absent] = 0
        place[model.keys[place] != keys] = absent
        place[:, :, -1][place[:, :, -1] == absent] = unknown
        alpha = np.concatenate((tail[:live], np.zeros((live, STRIDE, n))), axis=1)
        for k in range(STRIDE):
            alpha[:, wide + k] = (alpha[:, k : k + wide] * probs[place[:, k]]).sum(axis=1)
        over = np.flatnonzero(sizes[:live] <= done + STRIDE)
        out[over] = logs[over] + np.log(alpha[over, wide - 1 + sizes[over] - done])
        scale = alpha[:, -1]
        scale[over] = 1.0
        tail = alpha[:, STRIDE:] / scale[:, None]
        logs[:live] += np.log(scale)
    return out


# ---- training -----------------------------------------------------------------------------------


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` texts of each language, by a hash of the id: the same ones each time, no sort, no window."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.broadcast(counts.select("lang", (F.lit(per_language) / F.col("n")).alias("share")))  # one row per language
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return labelled.join(share, "lang").where(place < F.col("share")).select("lang", "text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text", COUNT_BYTES):
            lower = pc.utf8_lower(rows.column("text"))
            data, offsets = text_buffer(lower)
            starts, ends, text = word_spans(data, offsets)
            words = pa.table([rows.column("lang").take(pa.array(text)), _decoded(data, starts, ends)], names=["lang", "word"])
            counted = words.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
            yield from counted.rename_columns({"count_all": "n"}).select(["lang", "word", "n"]).combine_chunks().to_batches()


def _decoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)])]).cast(pa.string())


def train(labelled: DataFrame, vocabulary: str = VOCABULARY, per_language: int | None = None, rounds: int = ROUNDS) -> Model | None:
    """Fit on all ``labelled`` rows (``id, lang, text``, no NULLs in ``lang`` and ``text``); None if it has no language.

    The words of all texts are counted once; each round goes over distinct words. Only a caller that names
    ``per_language`` gets a model of so many texts of each language. What reaches the driver is one row per language
    and one per piece and language, bounded by the vocabulary.
    """
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return None
    pieces = [p for p in load(vocabulary).ids if p == MARK or p.strip(MARK)]
    pieces = sorted({p.lower() for p in pieces})
    keys = piece_keys(pieces)
    order = np.argsort(keys)
    model = Model(languages, keys[order], order, np.full((len(pieces), len(languages)), 1 / len(pieces)), max(map(len, pieces)))
    texts = labelled.select("lang", "text") if per_language is None else _sample(labelled, per_language)
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    types = written(counted, "words")
    for _ in range(rounds):
        got = types.mapInArrow(_expectation(model), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full_like(model.probs, SMOOTHING)
        for r in got:
            counts[r["piece"], r["lang"]] += r["n"]
        model = Model(languages, model.keys, model.pieces, counts / counts.sum(axis=0), model.longest)
    return model


def _expectation(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(model.languages)}
        total = np.zeros_like(model.probs)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"), float)
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], int)
            for cps, lengths, word in units(words) if words else ():
                total += model.expected(cps, lengths, lang[word], n[word])
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, language])], names=["lang", "piece", "n"])

    return run


# ---- prediction ---------------------------------------------------------------------------------


class _Known:
    """Scores of words met before in this task; emptied when it holds ``KNOWN_WORDS``, which costs time, not results."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys, self.scores = np.empty(0, np.uint64), np.empty((0, len(self.model.languages)))

    def of(self, keys: np.ndarray, words: pa.Array) -> np.ndarray:
        """``keys`` sorted and distinct."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), len(self.model.languages)))
        if len(self.keys):
            out[old] = self.scores[at[old]]
        new = np.flatnonzero(~old)
        out[new] = word_scores(self.model, words.take(pa.array(new)).to_pylist())
        if len(self.keys) + len(new) > KNOWN_WORDS:
            self.clear()
        spot = np.searchsorted(self.keys, keys[new])
        self.keys, self.scores = np.insert(self.keys, spot, keys[new]), np.insert(self.scores, spot, out[new], axis=0)
        return out


def text_scores(known: _Known, texts: pa.Array, fits: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each text in each language, up to what all languages share.

    With ``fits`` also the scores and characters, marks included, of its words with letters and without digits (of
    all its words if there are none): keys, numbers and the like tell nothing of a language.
    """
    data, offsets = text_buffer(pc.utf8_lower(texts))
    starts, ends, text = word_spans(data, offsets)
    out = np.zeros((len(texts), len(known.model.languages)))
    part, chars = np.zeros_like(out), np.zeros(len(texts))
    if len(starts):
        keys, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        words = _decoded(data, starts[first], ends[first])
        scores = known.of(keys, words)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(text, weights=scores[back, k], minlength=len(texts))
        if fits:
            count = np.asarray(pc.match_substring_regex(words, r"^\PN*\pL\PN*$"))[back]
            count |= np.bincount(text, weights=count, minlength=len(texts))[text] == 0
            text, back = text[count], back[count]
            chars = np.bincount(text, weights=np.asarray(pc.utf8_length(words))[back] + 1.0, minlength=len(texts))
            for k in range(out.shape[1]):
                part[:, k] = np.bincount(text, weights=scores[back, k], minlength=len(texts))
    return (out, part, chars) if fits else out


def predict(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability (equal priors) added.

    A NULL text, one without any letter, and every text if no language was learned are ``und`` with score 0. Ties go
    to the language that comes first. Columns of the input named like the new ones are replaced, others pass
    through; rows stay as they are, repeated ones too. A text is scored in one task, whatever its length, by its
    distinct words; a run without white space is one word, summed over all its segmentations. ``fit`` names a third column:
    ``mean``, the log score per character under the predicted language, and ``weight``, ``sqrt(chars / FIT_CHARS)`` and 1
    at most, since the mean of a short text is less certain; NULL where the language is ``und``.
    """
    base = docs.drop(pred, score, *([fit] if fit else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", `{pred}` string, `{score}` double" + (f", `{fit}` struct<mean: double, weight: double>" if fit else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model) if model else None
        for batch in batches:
            for rows in slices(batch, text):
                texts = rows.column(text).fill_null("")
                letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
                best, prob = np.zeros(len(texts), int), np.zeros(len(texts))
                mean, weight = np.zeros(len(texts)), np.zeros(len(texts))
                if model:
                    logs = text_scores(known, texts, bool(fit))
                    if fit:
                        logs, part, chars = logs
                        mean = part[np.arange(len(texts)), logs.argmax(axis=1)] / np.maximum(chars, 1)
                        weight = np.sqrt(np.minimum(chars / FIT_CHARS, 1))
                    best = logs.argmax(axis=1)
                    prob = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                names = np.array(model.languages if model else ["und"], object)[best]
                sure = letters & bool(model)
                fitted = [pa.StructArray.from_arrays([pa.array(mean), pa.array(weight)], names=["mean", "weight"], mask=pa.array(~sure))] if fit else []
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.where(sure, names, "und"), pa.string()), pa.array(np.where(sure, prob, 0.0)), *fitted],
                    names=[*rows.schema.names, pred, score, *([fit] if fit else [])],
                )

    return base.mapInArrow(run, schema)


def fit_floors(told: DataFrame, pred: str = "lang_pred", fit: str = "fit", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """``language: (usual, floor)``: its median log score per character and how far a text of it may be below, times ``weight``.

    Learned from all labelled rows of ``told``, which ``predict`` has given ``pred`` and ``fit``, held-out ones included;
    it is read twice, so write it before. The floor is twice the distance that one row in a thousand exceeds, one nat per
    character at least; a text below it is in no language that was learned. Rows are counted by their score with
    ``FIT_DIGITS`` decimals, so a language has some 100,000 counts at most, however many rows. What reaches the driver
    is two numbers per language.
    """
    rows = told.where(F.col(lang).isNotNull() & F.col(fit).isNotNull()).select(F.col(pred).alias("pred"), F.col(fit).alias("fit"))
    usual = _percentile(rows, ["pred"], F.col("fit.mean"), 0.5, "usual")
    below = _percentile(rows.join(F.broadcast(usual), "pred"), ["pred", "usual"], (F.col("usual") - F.col("fit.mean")) * F.col("fit.weight"), 0.999, "far")
    return {r["pred"]: (r["usual"], -max(2 * r["far"], 1.0)) for r in below.collect()}


def _percentile(rows: DataFrame, by: list[str], value: Column, part: float, name: str) -> DataFrame:
    """Over all rows of each group, from counts of the rounded values."""
    counts = rows.groupBy(*by, F.round(value, FIT_DIGITS).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.percentile("value", F.lit(part), F.col("n")).alias(name))


def fits(fit: Column, pred: Column, floors: dict[str, tuple[float, float]]) -> Column:
    """Whether a text is as likely as texts of its predicted language are; true where nothing was learned of that."""
    bounds = F.create_map(*(x for k, (usual, floor) in floors.items() for x in (F.lit(k), F.array(F.lit(usual), F.lit(floor))))) if floors else None
    if bounds is None:
        return F.lit(True)
    return F.coalesce((fit["mean"] - bounds[pred][0]) * fit["weight"] >= bounds[pred][1], F.lit(True))


def held_out(id_column: str = "doc_id"):
    """Rows that training never sees: a quarter, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, id_column: str = "doc_id", lang: str = "lang", text: str = "text", **options) -> Model | None:
    """Fit on the rows with a language and a text that are not held out."""
    rows = docs.where(~held_out(id_column) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return train(rows.select(F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")), **options)
