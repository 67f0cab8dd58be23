"""The pieces of a public SentencePiece vocabulary, read from its file."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Its path is a parameter everywhere; the driver reads it and ships the pieces, executors need no file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands for a blank in pieces.
MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with ids and log scores, and the ids of the 256 byte pieces.

    The file ranks its pieces; a piece of rank ``r`` gets the log score ``-log(r + 1)`` less a constant, which makes
    the scores a probability distribution.
    """

    ids: dict[str, int] = field(repr=False)
    scores: dict[str, float] = field(repr=False)
    bytes_: tuple[int, ...] = field(repr=False)
    longest: int = 0

    @property
    def texts(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}


def load(path: str = VOCABULARY) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    bytes_ = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
    plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    ids = {model.id_to_piece(i): i for i in ranked}
    scores = {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)}
    return Vocabulary(ids, scores, tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)), max(map(len, ids)))
