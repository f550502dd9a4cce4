"""The vocabulary of a public sentencepiece BPE model, read once on the driver and handed to tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = "▁"
#: Code points whose words are worked on together.
CHUNK = 250_000
#: A word: spaces and the run behind them. No piece goes over the end of such a word.
WORD = re.compile(r" *[^ ]+| +")


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]  # by id
    rank: dict[str, int]  # of pieces that merges can make: 0 is merged first, equal scores share a rank
    ids: dict[str, int]  # the same pieces
    byte_ids: list[int]  # of byte 0 to 255
    control: frozenset[int]
    unknown: int
    word_bound: bool  # no piece has a space behind another character


def load(path: str) -> Vocabulary:
    """Reads the model file. Byte fallback and the identity normaliser with a dummy prefix are taken for granted and checked."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
    place = {s: k for k, s in enumerate(scores)}
    if sp.encode("a  ﬁ", out_type=str)[0][0] != SPACE or sp.decode(sp.encode("a  ﬁ ")) != "a  ﬁ ":
        raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
    return Vocabulary(
        pieces=pieces,
        rank={pieces[i]: place[sp.get_score(i)] for i in plain},
        ids={pieces[i]: i for i in plain},
        byte_ids=[sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        control=frozenset(i for i in range(n) if sp.is_control(i)),
        unknown=sp.unk_id(),
        word_bound=not any(SPACE in p.lstrip(SPACE) for p in (pieces[i] for i in plain)),
    )


def words(text: str | None, vocabulary: Vocabulary) -> list[str]:
    """The text, with its dummy prefix, cut into words that are encoded on their own; spaces stand for the space sign."""
    if not text:
        return []
    text = " " + text.replace(SPACE, " ")
    return WORD.findall(text) if vocabulary.word_bound else [text]


def chunks(column, most: int = CHUNK) -> Iterator[list[str | None]]:
    """Runs of an Arrow column's texts of about that many code points; a longer text is a run of its own."""
    part, size = [], 0
    for value in column:
        text = value.as_py()
        part.append(text)
        size += len(text or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
