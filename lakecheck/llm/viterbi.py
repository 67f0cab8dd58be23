"""SentencePiece encoding and decoding: best segmentations over a trie of distinct words.

A text is cut before blanks; each part with its mark is a word, and a run of blanks belongs to the word behind it,
so pieces of several marks take part. The distinct words of a slice are sorted, which lays them out as a trie in
depth-first order. Going from one word to the next, the forward scores of their common prefix stay on the stack, and
only positions beyond it are worked out, each by one walk through a trie of the pieces read from their ends. Words
met before in a task are not segmented again.

The segmentation is the one with the greatest sum of piece scores (see ``pieces.Vocabulary``); of equal ones that
with the longest last piece. A character without a piece is written as its UTF-8 bytes, as are line feeds and marks
that stand in the text itself, so every text is read back exactly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lakecheck.llm.arrow import STEP_BYTES, ragged, slices, strings, tidy
from lakecheck.llm.pieces import MARK, VOCABULARY, Vocabulary, load

#: Log score of one byte piece.
BYTE_SCORE = -25.0
#: First character of a word that follows a line feed and so has no mark.
BARE = "\n"
KNOWN_WORDS = 300_000
#: Ids handled at once when texts are read back; those of a longer text go through in parts.
STEP_TOKENS = 1 << 17
_BREAKS = re.compile("\n| {2,}")


def _endings(vocabulary: Vocabulary) -> dict:
    """Trie of the pieces read from their ends: by character a node ``[score, id, nodes behind]``, without a piece ``[None, -1, ..]``.

    Blanks of a run stand in it as blanks, not as marks.
    """
    root: dict = {}
    for piece, score in vocabulary.scores.items():
        for form in (piece, piece.replace(MARK, " ")) if MARK not in piece[1:] else (piece.replace(MARK, " "),):
            nodes, node = root, None
            for c in reversed(form):
                node = nodes.setdefault(c, [None, -1, {}])
                nodes = node[2]
            node[:2] = score, vocabulary.ids[piece]
    return root


class Segmenter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_ = vocabulary.bytes_
        self.endings = _endings(vocabulary)
        self.forget()

    def forget(self) -> None:
        """Empty the table of known parts: where their pieces start in ``flat``."""
        self.known: dict[str, tuple[int, ...]] = {}
        self.place = {"\n": 0, "\n\n": 1}
        self.flat, self.starts = array("i", [self.bytes_[0x0A]]), array("q", [0, 0, 1])

    def learn(self, words: Iterable[str]) -> None:
        """Segment the distinct ``words``, depth-first over their trie.

        Per position of the word at hand: the best score of what is before it, where the last piece of that starts,
        and its id, -1 if it is a character written as bytes.
        """
        score, back, took, last, root = [0.0], [0], [-1], "", self.endings
        for word in sorted(words):
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            del score[same + 1 :], back[same + 1 :], took[same + 1 :]
            least = 1 if word[:1] == BARE else 0
            if same < least:
                score.append(0.0)
                back.append(0)
                took.append(-1)
                same = 1
            for end in range(same, len(word)):
                c = word[end]
                best, start, piece = score[end] + BYTE_SCORE * (1 if c < "\x80" else len(c.encode())), end, -1
                nodes, at = root, end
                if c != MARK or not end:
                    while at >= least:
                        c = word[at]
                        node = nodes.get(c)
                        if node is None or (c == MARK and at):
                            break
                        own, number, nodes = node
                        if own is not None and score[at] + own >= best:
                            best, start, piece = score[at] + own, at, number
                        at -= 1
                score.append(best)
                back.append(start)
                took.append(piece)
            out: list[int] = []
            stop = len(word)
            while stop > least:
                start = back[stop]
                if took[stop] >= 0:
                    out.append(took[stop])
                else:
                    out.extend(self.bytes_[b] for b in reversed(word[start:stop].encode()))
                stop = start
            self.known[word] = tuple(reversed(out))
            last = word

    @staticmethod
    def parted(texts: pa.Array) -> pa.Array:
        """Texts whose parts stand between single blanks, each of which is the mark of the part behind it.

        A part that starts with line feeds is none with a mark: after one of them stands a word behind a line feed,
        which may be empty; two are a line feed; three and more stand for one blank less in front of a word.
        """
        odd = np.asarray(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")))
        out = pc.replace_substring(texts, "\n", " \n\n \n")
        if odd.any():
            code = lambda m: " \n\n \n" if m[0] == "\n" else " " + "\n" * (len(m[0]) + 1)
            changed = [_BREAKS.sub(code, " " + t).removeprefix(" ") for t in texts.filter(pa.array(odd)).to_pylist()]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(changed, out.type))
        return pc.if_else(pc.equal(texts, ""), "\n", out)

    @staticmethod
    def _word(part: str) -> str:
        """A part as ``learn`` takes it."""
        if part[:1] != "\n":
            return MARK + part
        bare = part.lstrip("\n")
        return BARE + part[1:] if part[1:2] != "\n" else " " * (len(part) - len(bare) - 1) + bare

    def _places(self, parts: list[str]) -> np.ndarray:
        """Places of distinct parts in the table; new ones are segmented first."""
        new = [p for p in parts if p not in self.place]
        if len(self.place) + len(new) > KNOWN_WORDS:
            self.forget()
            new = [p for p in parts if p not in self.place]
        words = [self._word(p) for p in new]
        self.learn(words)
        for part, word in zip(new, words):
            self.place[part] = len(self.starts) - 1
            self.flat.extend(self.known[word])
            self.starts.append(len(self.flat))
        self.known = {}
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has; NULL has none. A long text is done by stretches of whole parts."""
        texts = self.parted(texts.fill_null("").cast(pa.large_string()))
        ids, lengths = [], np.zeros(len(texts), np.int64)
        if texts.nbytes <= 4 * STEP_BYTES:
            ids, lengths = self._looked_up(texts)
            return ids, lengths
        for i, text in enumerate(texts.to_pylist()):
            for stretch in _stretches(text):
                some, n = self._looked_up(pa.array([stretch], pa.large_string()))
                ids.append(some)
                lengths[i] += n[0]
        return np.concatenate(ids), lengths

    def _looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        starts, flat = np.array(self.starts, np.int64), np.frombuffer(self.flat, np.int32)
        sizes = starts[place + 1] - starts[place]
        so_far = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.asarray(cut.offsets) - np.asarray(cut.offsets)[0]
        return flat[ragged(starts[place], sizes)], np.diff(so_far[bounds])

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, lengths = self.pieces(pa.array(texts, pa.string()))
        ends = np.cumsum(lengths)
        return [None if t is None else ids[e - n : e].tolist() for t, e, n in zip(texts, ends, lengths)]


def _stretches(text: str) -> Iterator[str]:
    """``text`` cut at single blanks, which go, into stretches of about ``STEP_BYTES`` characters."""
    at = 0
    while at >= 0:
        stop = text.find(" ", at + STEP_BYTES)
        yield text[at:] if stop < 0 else text[at:stop]
        at = stop + 1 if stop >= 0 else -1


def _encoded(batch: pa.RecordBatch, text: str, segmenter: Segmenter) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for rows in slices(batch, text):
        ids, lengths = segmenter.pieces(rows.column(text))
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        yield rows, pa.ListArray.from_arrays(offsets, pa.array(ids), mask=rows.column(text).is_null())


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, text: str = "text", tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``tokens``, the piece ids of ``text``, added; all rows and other columns pass through.

    A NULL text has NULL tokens, an empty one none. A column of the input with that name is replaced. A text is
    segmented whole, in one task, word by word; a run without blanks is one word.
    """
    base, words = docs.drop(tokens), load(vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words)
        for batch in batches:
            for rows, ids in _encoded(batch, text, segmenter):
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*rows.schema.names, tokens])

    return base.mapInArrow(run, f"{_fields(base)}, `{tokens}` array<int>")


def decode(df: DataFrame, tokens: str = "tokens", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text that ``tokens`` stand for; NULL for NULL, empty for none. Bytes that are no UTF-8 become U+FFFD."""
    base, words = df.drop(text), load(vocabulary)
    table = {i: p.replace(MARK, " ").encode() for p, i in words.ids.items()} | {i: bytes([b]) for b, i in enumerate(words.bytes_)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [table.get(i, b"") for i in range(max(table) + 1)]
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        data, begin = np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            offsets = np.asarray(batch.column(tokens).offsets, np.int64)
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[at] + STEP_TOKENS, side="right")) - 1
                stop = min(max(stop, at + 1), batch.num_rows)
                rows = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*rows.columns, _read(rows.column(tokens), data, begin, sizes)], names=[*rows.schema.names, text])
                at = stop

    return base.mapInArrow(run, f"{_fields(base)}, `{text}` string")


def _read(column: pa.Array, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of lists of ids; piece ``i`` is ``data[begin[i] : begin[i] + sizes[i]]``. The blank put before a text goes."""
    offsets = np.asarray(column.offsets, np.int64)
    ids = np.asarray(column.values)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    length = sizes[ids]
    first = offsets[:-1][np.diff(offsets) > 0]
    marked = first[data[begin[ids[first]]] == 0x20]
    length[marked] -= 1
    so_far = np.concatenate(([0], np.cumsum(length)))
    skip = np.zeros(len(ids), bool)
    skip[marked] = True
    out = np.empty(so_far[-1], np.uint8)
    for at in range(0, len(ids), STEP_TOKENS):
        stop = min(at + STEP_TOKENS, len(ids))
        out[so_far[at] : so_far[stop]] = data[ragged(begin[ids[at:stop]] + skip[at:stop], length[at:stop])]
    return _texts(out, so_far[offsets], column.is_null())


def _texts(data: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    """A string column over UTF-8 bytes; NULL where ``null`` is true."""
    out = strings(data, offsets)
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        out = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string())
    return pc.if_else(null, pa.scalar(None, pa.large_string()), out).cast(pa.string())
