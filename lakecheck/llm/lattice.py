"""Scores of texts under a subword lattice: log probabilities summed over all segmentations.

The pieces are those of one fixed public vocabulary, and its own scores are where their weights start. From there the
weights are fitted to the training texts: expected piece counts over all segmentations of the counted words are added
to the vocabulary's scores as prior counts, ``ROUNDS`` times. The probability of a word, with its mark, is the sum over
all ways to cut it into pieces, worked out by the forward recursion in log space; that of a text is the product over its
words and one end.

Each distinct word of all texts goes through the recursion once. Texts take the numbers of frequent words from a
broadcast table of bounded size and those of all others by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm import trie
from lakecheck.llm.arrow import ragged, slices, text_buffer
from lakecheck.llm.pieces import MARK, VOCABULARY, load
from lakecheck.llm.storage import written
from lakecheck.llm.tokens import counted, distinct
from lakecheck.llm.words import LOWER, word_spans

#: Folds by checksum of the id, and the one that is held out.
FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
#: Pieces that the vocabulary's own scores count for beside those of the corpus.
PRIOR = 10_000.0
#: Prior count of a character without a piece and of the end; such a character is one of all code points.
RARE = 1.0
CODE_POINTS = 0x110000
#: Most words of the broadcast table.
KNOWN = 1 << 17
#: Characters of a block; a longer word goes through the recursion in stretches.
BLOCK = 1 << 18


@dataclass
class Lattice:
    """``piece[node]``: number of the piece that ends at a node of the trie, or -1; ``logs``: natural logs of its weight."""

    tree: trie.DoubleArray
    symbols: np.ndarray
    piece: np.ndarray
    longest: int
    prior: np.ndarray
    logs: np.ndarray
    unknown: float
    end: float

    @classmethod
    def of(cls, vocabulary: str = VOCABULARY) -> Lattice:
        """From the scores of a vocabulary. Pieces with capital ASCII letters never match and are left out."""
        words = load(vocabulary)
        pieces = sorted(p for p in words.scores if not any("A" <= c <= "Z" for c in p))
        letters = sorted(set("".join(pieces)))
        symbols = np.zeros(CODE_POINTS, np.int32)
        symbols[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        node = {"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
        tree = trie.build(np.array([node[p[:-1]] for p in prefixes]), np.array([symbols[ord(p[-1])] for p in prefixes], np.int64))
        piece = np.full(len(node), -1, np.int32)
        piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        scores = np.exp(np.array([words.scores[p] for p in pieces]))
        empty = cls(tree, symbols, piece, max(map(len, pieces)), PRIOR * scores / scores.sum(), np.empty(0), 0.0, 0.0)
        return empty.fitted(np.zeros(len(pieces)), 0.0, 0.0)

    def fitted(self, counts: np.ndarray, unknown: float, ends: float) -> Lattice:
        """Weights from counts of pieces, of characters without one, and of ends, each added to its prior count."""
        weights = counts + self.prior
        total = math.log(weights.sum() + unknown + ends + 2 * RARE)
        return Lattice(self.tree, self.symbols, self.piece, self.longest, self.prior, np.log(weights) - total, math.log(unknown + RARE) - total, math.log(ends + RARE) - total)

    @property
    def bare(self) -> float:
        """Log weight of one given character without a piece."""
        return self.unknown - math.log(CODE_POINTS)

    def matches(self, symbols: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, piece)`` of all pieces that start before ``stop``; ``longest`` symbols follow it."""
        at, states, found = np.arange(stop), np.full(stop, trie.ROOT, np.int32), []
        for k in range(self.longest):
            states = self.tree.step(states, symbols[at + k])
            alive = np.flatnonzero(states)
            at, states = at[alive], states[alive]
            piece = self.piece[self.tree.item[states]]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], np.full(len(whole), k + 1), piece[whole]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def recursion(self, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None):
        """Log probabilities of words, and with ``weights`` the expected counts of pieces and of bare characters.

        ``codes`` holds the words one after the other, each followed by one 0. The cell of a prefix is the place behind
        it. Cells are worked out by the length of their prefixes, for all words together.
        """
        n = len(codes)
        symbols = np.concatenate((self.symbols[codes], np.zeros(self.longest + 1, np.int32)))
        start, size, piece = self.matches(symbols, n)
        offset = np.arange(n) - np.repeat(begins, lengths + 1)
        inside = np.flatnonzero(np.arange(n) < np.repeat(begins + lengths, lengths + 1))
        start = np.concatenate((start, inside))
        stop = np.concatenate((start[: len(size)] + size, inside + 1))
        value = np.concatenate((self.logs[piece], np.full(len(inside), self.bare)))
        piece = np.concatenate((piece, np.full(len(inside), -1, np.int32)))
        order = np.lexsort((piece, stop, offset[stop]))
        start, stop, value, piece = start[order], stop[order], value[order], piece[order]
        first = np.ones(len(stop), bool)
        first[1:] = stop[1:] != stop[:-1]
        heads = np.flatnonzero(first)
        levels = np.searchsorted(offset[stop], np.arange(1, int(lengths.max(initial=0)) + 2))
        alpha = np.zeros(n)
        for a, b in zip(levels[:-1], levels[1:]):
            here = heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a
            paths = alpha[start[a:b]] + value[a:b]
            most = np.maximum.reduceat(paths, here)
            sums = np.add.reduceat(np.exp(paths - np.repeat(most, np.diff(np.append(here, b - a)))), here)
            alpha[stop[a:b][here]] = most + np.log(sums)
        ends = begins + lengths
        if weights is None:
            return alpha[ends]
        mass, share = np.zeros(n), np.zeros(len(stop))
        mass[ends] = weights
        bare = piece < 0
        for a, b in zip(levels[-2::-1], levels[:0:-1]):
            share[a:b] = np.exp(alpha[start[a:b]] + value[a:b] - alpha[stop[a:b]]) * mass[stop[a:b]]
            # a place starts one piece and one bare character at most that end on one level
            for kind in (bare[a:b], ~bare[a:b]):
                mass[start[a:b][kind]] += share[a:b][kind]
        return alpha[ends], np.bincount(piece[~bare], weights=share[~bare], minlength=len(self.logs)), float(share[bare].sum())

    def long_word(self, codes: np.ndarray) -> float:
        """Log probability of one word, in stretches; only the open cells of one piece length are held."""
        size, add = self.longest + 1, math.log1p
        cells = [-math.inf] * size
        cells[0] = 0.0
        bare = self.bare
        for at in range(0, len(codes), BLOCK):
            stop = min(at + BLOCK, len(codes))
            symbols = np.zeros(stop - at + self.longest + 1, np.int32)
            ahead = codes[at : stop + self.longest]
            symbols[: len(ahead)] = self.symbols[ahead]
            start, length, piece = self.matches(symbols, stop - at)
            order = np.argsort(start, kind="stable")
            bounds = np.searchsorted(start[order], np.arange(stop - at + 1)).tolist()
            lengths, values = length[order].tolist(), self.logs[piece[order]].tolist()
            for k in range(stop - at):
                here = (at + k) % size
                own, cells[here] = cells[here], -math.inf
                for j in range(bounds[k], bounds[k + 1] + 1):
                    step, v = (lengths[j], own + values[j]) if j < bounds[k + 1] else (1, own + bare)
                    to = (here + step) % size
                    old = cells[to]
                    hi, lo = (old, v) if old > v else (v, old)
                    cells[to] = hi + add(math.exp(lo - hi)) if lo > -math.inf else hi
        return cells[len(codes) % size]


def _blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, code points, begins, lengths)``: marked words by length, each followed by a 0, in blocks."""
    texts = words.to_pylist()
    lengths = np.fromiter((len(w) + 1 for w in texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(lengths[order] + 1)
    at = 0
    while at < len(order):
        before = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, before + BLOCK, side="right")), at + 1)
        rows = order[at:stop]
        codes = np.frombuffer("".join(MARK + texts[i] + "\0" for i in rows).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths[rows] + 1)[:-1]))
        yield rows, codes, begins, lengths[rows]
        at = stop


def word_logs(model: Lattice, words: pa.Array) -> np.ndarray:
    """Natural logs of the probabilities of words."""
    out = np.zeros(len(words))
    for rows, codes, begins, lengths in _blocks(words):
        if lengths[-1] > BLOCK:
            out[rows] = model.long_word(codes[:-1])
        else:
            out[rows] = model.recursion(codes, begins, lengths)
    return out


def _expectation(model: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bare = np.zeros(len(model.logs)), 0.0
        for batch in batches:
            n = np.asarray(batch.column("c"), float)
            for rows, codes, begins, lengths in _blocks(batch.column("word")):
                weights = n[rows]
                if lengths[-1] > BLOCK:
                    # counts of one very long word, from stretches of it
                    parts = np.full(-(-int(lengths[0]) // (1 << 12)), 1 << 12)
                    parts[-1] -= parts.sum() - lengths[0]
                    begins = np.cumsum(parts + 1) - parts - 1
                    cut = np.zeros(int(parts.sum()) + len(parts), np.int64)
                    cut[ragged(begins, parts)] = codes[:-1]
                    for k in range(0, len(parts), 64):
                        own = slice(int(begins[k]), int(begins[k] + (parts[k : k + 64] + 1).sum()))
                        _, counts, plain = model.recursion(cut[own], begins[k : k + 64] - begins[k], parts[k : k + 64], np.full(len(parts[k : k + 64]), weights[0]))
                        total, bare = total + counts, bare + plain
                    continue
                _, counts, plain = model.recursion(codes, begins, lengths, weights)
                total, bare = total + counts, bare + plain
        piece = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.append(total, bare)[piece])], names=["piece", "n"])

    return run


def fit(types: DataFrame, ends: int, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Lattice:
    """The lattice fitted to training words (``word, c``) and ``ends``; the driver gets one row per piece of the vocabulary."""
    model = Lattice.of(vocabulary)
    for _ in range(rounds):
        counts, bare = np.zeros(len(model.logs)), 0.0
        got = types.where("c > 0").select("word", "c").mapInArrow(_expectation(model), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        for r in got.collect():
            if r["piece"] < 0:
                bare = r["n"]
            else:
                counts[r["piece"]] = r["n"]
        model = model.fitted(counts, bare, float(ends))
    return model


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from, by checksum of the id; a row without an id is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_types(rows: DataFrame) -> DataFrame:
    """``word, c``: the distinct words of all texts (``text, held``) and their occurrences in those that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, row = word_spans(data, offsets)
                if len(starts):
                    words, which = distinct(data, starts, ends)
                    learned = ~np.asarray(part.column("held"))[row]
                    yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(which, weights=learned, minlength=len(words)).astype(np.int64))], names=["word", "c"])

    return rows.select("text", "held").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(types: DataFrame, most: int) -> pa.Table:
    """The words with the highest counts, down to a power of two, ``most`` at most: chosen from counts of counts."""
    kinds = types.where("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("words"))
    least, held = None, 0
    for r in sorted(kinds.collect(), key=lambda r: -r["kind"]):
        held += r["words"]
        if held > most:
            break
        least = 1 << r["kind"]
    return (types.where(F.col("c") >= least) if least else types.limit(0)).toArrow()


@dataclass
class Totals:
    """Training tokens, distinct ones, and texts."""

    tokens: int
    distinct: int
    ends: int

    def base(self, c: np.ndarray | float) -> np.ndarray | float:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _partly(rows: DataFrame, known: pa.Table, totals: Totals) -> DataFrame:
    """Sums over the words in ``known`` of each text, and its other words with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast((known.column("word").combine_chunks(), np.asarray(known.column("c"), float), np.asarray(known.column("log"))))
    names = ["n", "n_known", "base", "log", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, c, log = shared.value
        base = totals.base(c)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, row = word_spans(data, offsets)
                words, which = distinct(data, starts, ends)
                row, which, n = counted(row, which)
                place = np.asarray(pc.index_in(words, value_set=vocabulary).fill_null(-1), np.int64)[which]
                there, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                total = lambda rows, w: np.bincount(rows, weights=w, minlength=part.num_rows).astype(float)
                k, m = place[there], n[there]
                lists = np.concatenate(([0], np.cumsum(np.bincount(row[rest], minlength=part.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("held"),
                        pa.array(total(row, n).astype(np.int64)),
                        pa.array(total(row[there], m).astype(np.int64)),
                        pa.array(total(row[there], m * base[k])),
                        pa.array(total(row[there], m * log[k])),
                        pa.ListArray.from_arrays(pa.array(lists), words.take(pa.array(which[rest]))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(n[rest])),
                    ],
                    names=["id", "held", *names],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held boolean, n long, n_known long, base double, log double, words array<string>, counts array<long>")


def lattice_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row for each row of ``docs``.

    ``score`` is the log10 probability of the text under the lattice, ``base_score`` under smoothed word counts. Words are
    cut at ASCII white space, A-Z in lower case. A NULL text is empty and so has the end only; rows with a NULL id are
    learned from; repeated rows count each and have equal scores. Columns other than the two named do not matter. With
    nothing to learn from, ``train_tokens`` is 0 and the vocabulary's own scores hold.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held_out(id_column).alias("held"))
    counts = written(word_types(rows), "types")
    learned = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = rows.where(~F.col("held")).count()
    totals = Totals(learned[0] + ends, learned[1] + (ends > 0), ends)
    model = fit(counts, ends, vocabulary, rounds)
    types = written(_with_logs(counts, model), "scored-types")
    parts = written(_partly(rows, _frequent(types, known), totals).withColumn("row", F.monotonically_increasing_id()), "partly")
    rest = parts.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("m"))
    smooth = F.log10((F.col("c") + 0.5) / F.lit(totals.tokens + 0.5 * (totals.distinct + 1)))
    added = rest.join(types, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known_too"),
        F.sum(F.col("m") * smooth).alias("base_too"),
        F.sum(F.col("m") * F.col("log")).alias("log_too"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("words", "counts").join(added, "row", "left").select(
        F.col("id").alias(id_column),
        F.col("held").alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("n_known") + zero("known_too") + (1 if ends else 0)).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_too") + float(totals.base(ends))).alias("base_score"),
        ((F.col("log") + zero("log_too") + model.end) / math.log(10)).alias("score"),
    )


def _with_logs(types: DataFrame, model: Lattice) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(word_logs(model, batch.column("word")))], names=["word", "c", "log"])

    return types.mapInArrow(run, "word string, c long, log double")
