"""The vocabulary of a sentencepiece BPE model, read for our own encoder.

Only what a model file states is taken from the library (pieces, scores, kinds);
segmentation is done in :mod:`sparkloom.llm.sentencepiece_codec`.
"""

from __future__ import annotations

SPACE = "▁"


class Vocabulary:
    """Pieces by id, and the kinds of their ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.scores = [model.get_score(i) for i in range(self.size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(self.size) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.normal = {
            p: i
            for i, p in enumerate(self.pieces)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }


def segments(text: str) -> list[str]:
    """Cut a text where no piece of the vocabulary can span the cut.

    Blanks stand for space marks and a dummy mark goes in front.  A segment is a run
    of marks and what follows up to the next mark; it is given without its first
    mark, so a text of words with single blanks is simply split at them.
    """
    if not text:
        return []
    text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if "  " not in text and parts[0]:
        return parts
    out, lead, last = [], "", len(parts) - 1
    for k, part in enumerate(parts):
        if part:
            out.append(lead + part)
            lead = ""
        elif k < last:
            lead += SPACE
        else:
            out.append(lead)
    return out


def pieces_apart(segment: str, inner: frozenset[str]) -> list[str]:
    """Cut a segment around characters that no longer piece contains."""
    if inner.isdisjoint(segment):
        return [segment]
    cut, start = [], 0
    for k, ch in enumerate(segment):
        if ch in inner:
            if k > start:
                cut.append(segment[start:k])
            cut.append(ch)
            start = k + 1
    if start < len(segment):
        cut.append(segment[start:])
    return cut
