"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures over letter multisets.

A word is the multiset of its letters, seen as a binary vector with one dimension for each letter and occurrence. One
inserted or deleted letter changes one dimension and one replaced letter two, so near words have vectors with a Hamming
distance of two at most. The dimensions are cut into ``PARTS`` parts; two differing dimensions touch two parts at most,
so some set of ``PARTS - 2`` parts is equal in both words. Each such set is a signature. One edit also leaves the first
or the last ``least // 2`` letters of both words alone, so either end goes into the key too, which keeps words made of
the same letters apart. Words with an equal key are joined and each pair is verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.arrow import slices, text_buffer
from lakecheck.llm.storage import written
from lakecheck.llm.tokens import byte_set, counted, distinct, runs
from lakecheck.llm.words import LOWER, mix

#: Parts of the dimensions; ``PARTS * (PARTS - 1) / 2`` signatures for each end of a word.
PARTS = 5
#: Code points that a word has at least, occurrences, and times the word's occurrences that its form has.
LEAST, OFTEN, TIMES = 7, 2, 10
#: Letters are A-Z, a-z and U+00C0 to U+00FF, which are the byte 0xC3 and the one behind it.
_ASCII = byte_set(*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1))
_BLOCK = 1 << 16
#: Bytes of a run that are worked out for all runs together; the rest of a longer one is done alone.
_TOGETHER = 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 register after the bytes of each run, going on from ``state``; inverted it is the checksum."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32) if state is None else state.copy()
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    for k in range(min(int(sizes[0]), _TOGETHER) if len(sizes) else 0):
        live = order[: np.searchsorted(-sizes, -k, side="left")]
        now = out[live]
        out[live] = _CRC[(now ^ data[starts[live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in order[: np.searchsorted(-sizes, -_TOGETHER, side="left")]:
        out[i] = 0xFFFFFFFF ^ zlib.crc32(data[starts[i] + _TOGETHER : ends[i]], 0xFFFFFFFF ^ int(out[i]))
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", every: int | None = 31) -> DataFrame:
    """``word, n``: runs of letters of all texts, A-Z in lower case, and how often they occur.

    With ``every``, a run whose checksum with the row's id is divisible by it loses the letter at checksum modulo
    length. A NULL id counts as the text ``null``, a NULL text has no runs; repeated rows count each.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, row = runs(_letters(data), offsets)
                if every and len(starts):
                    ids, id_offsets = text_buffer(part.column("id"))
                    head = checksums(ids, id_offsets[:-1], id_offsets[1:])
                    head = _CRC[(head ^ np.uint32(ord(":"))) & np.uint32(255)] ^ (head >> np.uint32(8))
                    h = ~checksums(data, starts, ends, head[row])
                    data, starts, ends = _without(data, starts, ends, h, every)
                if len(starts):
                    words, which = distinct(data, starts, ends)
                    yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(which, minlength=len(words)))], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, every: int):
    """Runs of the given bytes with the chosen letters cut out."""
    begins = (data & 0xC0) != 0x80
    place = np.concatenate(([0], np.cumsum(begins)))
    at = np.flatnonzero(begins)
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    length = place[ends[hit]] - place[starts[hit]]
    cut = at[place[starts[hit]] + h[hit] % length]
    keep = np.ones(len(data), bool)
    keep[cut] = False
    wide = cut[data[cut] >= 0x80] + 1
    keep[wide] = False
    moved = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = moved[starts], moved[ends]
    full = ends > starts
    return data[keep], starts[full], ends[full]


def signatures(words: list[str], end: int) -> np.ndarray:
    """One row per word, one 64-bit key per end of the word and set of parts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    order = np.lexsort((flat, word))
    letter, owner = flat[order], word[order]
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(letter)), 0))
    dimension = mix((letter << np.uint64(24)) + (np.arange(len(letter)) - begin).astype(np.uint64) + np.uint64(1))
    part = (dimension >> np.uint64(40)) % np.uint64(PARTS)
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (owner, part.astype(np.int64)), dimension)
    keys = []
    for side in (0, 1):
        edge = np.full(len(words), side + 1, np.uint64)
        for k in range(end):
            edge = mix(edge * np.uint64(31) + flat[first + k if side == 0 else first + lengths - 1 - k])
        for chosen in combinations(range(PARTS), PARTS - 2):
            key = edge
            for p in chosen:
                key = mix(key + sums[:, p] * np.uint64(2 * p + 3))
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _signed(words: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                keys = signatures(part.column("word").to_pylist(), least // 2)
                # a word can have a key twice only by collision of hashes: pairs are made distinct later
                rows = np.repeat(np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column("word").take(pa.array(rows)), part.column("n").take(pa.array(rows))], names=["key", "word", "n"])

    return words.mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``a, b, a_n, b_n``: all pairs ``a < b`` of distinct ``word``s (with counts ``n``) that are one edit apart.

    Words have ``least`` code points or more. A pair is verified where it meets, so no candidate is written; one that
    meets under several keys is kept once. A key that many words share is split by adaptive execution.

    The joins here and below are told to merge. Spark takes the signatures for as large as the words' compressed file,
    though each word has twenty, and would broadcast them.
    """
    signed = _signed(words.select("word", "n"), least)
    left = signed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right.hint("merge"), "key").where(close).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def spelling_forms(words: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``, distinct words).

    ``form`` is the near word that occurs most (ties: the smallest), if at least ``times`` as often as the word, else
    NULL; ``root`` is where the forms lead in the end, the word itself without a form. Words of under ``least`` code
    points, NULL words and NULL counts are left out. No words give no rows.
    """
    sound = words.where(F.col("n").isNotNull() & (F.length("word") >= least)).select("word", "n")
    pairs = near_pairs(sound, least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = F.col("best").isNotNull() & (-F.col("best.less") >= F.col("n") * times)
    rows = sound.join(near.hint("merge"), "word", "left").select(
        "word",
        F.when(formed, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    rows = written(rows, "forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")), rows, times)
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, rows: DataFrame, times: int) -> DataFrame:
    """Where the forms end. Counts grow by ``times`` at each link, so a chain is short and doubling steps follow it."""
    most, least = rows.agg(F.max("n"), F.min("n")).first()
    longest, reach = 0, (least or 1) * times
    while most and reach <= most:
        longest, reach = longest + 1, reach * times
    step = 1
    while step < longest:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        step *= 2
    return links


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN, times: int = TIMES, every: int | None = 31) -> DataFrame:
    """``spelling_forms`` of the words of at least ``least`` code points and ``often`` occurrences in all texts.

    NULL and empty texts have no words, repeated rows count each, other columns do not matter, and empty tables give no
    rows. A text is read whole.
    """
    counts = word_counts(docs, id_column, text, every).where((F.col("n") >= often) & (F.length("word") >= least))
    return spelling_forms(written(counts, "words"), least, times)
