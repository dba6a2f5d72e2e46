"""Exact sentencepiece BPE encoding by backtracking, and decoding.

Method.  A text is cut where no piece can span (before runs of space marks).  In a
segment, Aho-Corasick gives the longest piece at each position.  Pieces are then
laid left to right, longest first; a piece is accepted when re-merging it next to
the piece before it leaves both whole.  Where no shorter piece fits either, the
position is marked failed in a bitfield and the last piece is taken back, so each
position fails once at most.  A piece sequence whose neighbours are all compatible
is the one that merging by score ends in.

Ranks: merging always joins the adjacent pair whose joint piece has the best score,
the leftmost on ties.  Pieces of space marks alone share one lowest score, so a run
of marks left over by the letters is joined from the left in pieces of the longest
length; it is handled apart.

Defined results: null and empty texts encode to the begin and end ids alone.
Characters outside the vocabulary become byte pieces.  A special piece's string
inside a text is ordinary text.  Decoding drops control ids, writes
" ⁇ " for the unknown id, joins byte pieces as UTF-8 (an invalid byte is
U+FFFD) and takes off the dummy prefix.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from sparkloom.llm._pieces import SPACE, Vocabulary, pieces_apart, segments

#: Longer segments are encoded anew each time; a worker's cache holds so many others.
CACHED_CHARS, CACHED_SEGMENTS = 48, 250_000


class Merger:
    """Merge relations of a vocabulary: ranks, derivations, compatible neighbours.

    Inside, a piece is a number: makable pieces first, then single characters in
    the order in which they are met.
    """

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.runs = sorted((len(p) for p in vocab.normal if len(p) > 1 and not p.strip(SPACE)), reverse=True)
        lettered = {p: i for p, i in vocab.normal.items() if len(p) == 1 or p.strip(SPACE)}
        # a rank for each piece that merging can make: better scores first
        order = sorted((p for p in lettered if len(p) > 1), key=lambda p: (-vocab.scores[lettered[p]], lettered[p]))
        self.rank: dict[str, int] = {}
        last, score = -1, None
        for p in order:
            if vocab.scores[lettered[p]] != score:
                last, score = last + 1, vocab.scores[lettered[p]]
            self.rank[p] = last
        self.never = last + 1
        # how a piece comes about on its own; those that end otherwise are never made
        made: dict[str, tuple[str, str]] = {}
        for p in order:
            if len(self.merge(list(p))) == 1:
                made[p] = self._last
        self.name = list(made)
        self.number = {p: k for k, p in enumerate(self.name)}
        self.born = [self.rank[p] for p in self.name]
        for p in made:
            for ch in p:
                self._char(ch)
        self.left = [self.number[made[p][0]] if p in made else -1 for p in self.name]
        self.right = [self.number[made[p][1]] if p in made else -1 for p in self.name]
        # plain: both halves were made earlier, so time in a derivation runs with rank
        self.plain = [True] * len(self.name)
        for k, p in enumerate(self.name):
            if p in made:
                self.plain[k] = all(self.plain[x] and self.born[x] < self.born[k] for x in (self.left[k], self.right[k]))
        self.joint: dict[int, int] = {}
        self.shorter = [-1] * len(self.name)
        for k, p in enumerate(self.name):
            for cut in range(len(p) - 1, 0, -1):
                a, b = self.number.get(p[:cut]), self.number.get(p[cut:])
                if a is not None and self.shorter[k] < 0:
                    self.shorter[k] = a  # the longest makable proper prefix
                if a is not None and b is not None:
                    self.joint[a << 24 | b] = self.born[k]
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, (len(p), self.number[p]))
        self.automaton.make_automaton()
        joined = {ch for p in made for ch in p} | {SPACE}
        self.inner = frozenset(ch for ch in "\n\t\r" if ch not in joined)
        self.fixed = len(self.name)

    def _char(self, ch: str) -> int:
        k = self.number.get(ch)
        if k is None:
            k = self.number[ch] = len(self.name)
            self.name.append(ch)
            self.born.append(-1)
            for held in ("left", "right", "shorter", "plain"):
                if hasattr(self, held):
                    getattr(self, held).append(True if held == "plain" else -1)
        return k

    def merge(self, parts: list[str]) -> list[str]:
        """Join adjacent parts, best rank first, the leftmost on ties, until none is left."""
        rank, never = self.rank, self.never
        while len(parts) > 1:
            best, at = never, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], never)
                if r < best:
                    best, at = r, k
            if at < 0:
                return parts
            self._last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two adjacent pieces ends in those two pieces."""
        known = self.fits.get(a << 24 | b)
        if known is None:
            if self.plain[a] and self.plain[b]:
                known = self._unwound(a, b)
            else:
                known = self.merge(list(self.name[a] + self.name[b])) == [self.name[a], self.name[b]]
            if len(self.fits) > 250_000:
                self.fits.clear()
            self.fits[a << 24 | b] = known
        return known

    def _unwound(self, a: int, b: int) -> bool:
        """Unmerge both sides of the boundary, latest first; no joint piece may come earlier.

        ``a`` stands until rank ``till_a``, ``b`` until ``till_b`` (then they are
        part of a longer piece of their own side).  A joint piece of ``a`` and ``b``
        wins against a later merge of either, and on equal ranks the leftmost wins.
        """
        joint, born, never = self.joint, self.born, self.never
        till_a = till_b = never
        while True:
            r = joint.get(a << 24 | b, never)
            if r < till_a and r <= till_b and r < never:
                return False
            born_a, born_b = born[a], born[b]
            if born_a > born_b:
                till_a, a = born_a, self.right[a]
            elif born_b >= 0:  # of the same piece on both sides the left one is merged first
                till_b, b = born_b, self.left[b]
            else:
                return True

    def split(self, text: str) -> list[int]:
        """The pieces of a segment without longer runs of marks inside, by backtracking."""
        n = len(text)
        number, name, fits, shorter = self.number, self.name, self.fits, self.shorter
        try:
            longest = [number[ch] for ch in text]
        except KeyError:
            longest = [self._char(ch) for ch in text]
        size = [1] * n
        for end, (m, k) in self.automaton.iter(text):
            start = end - m + 1
            if m > size[start]:
                size[start] = m
                longest[start] = k
        open_ = bytearray(b"\x01") * (n + 1)
        pieces: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            end = at + len(name[piece])
            if open_[end]:
                if last < 0:
                    fit = True
                else:
                    fit = fits.get(last << 24 | piece)
                    if fit is None:
                        fit = self.compatible(last, piece)
                if fit:
                    pieces.append(piece)
                    if end == n:
                        return pieces
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = shorter[piece]
            if piece < 0:
                open_[at] = 0
                piece = pieces.pop()
                at -= len(name[piece])
                last = pieces[-1] if pieces else -1

    def encode(self, segment: str) -> list[int]:
        """The ids of one segment (see :func:`segments`), its first mark included."""
        if len(segment) > 1 and not self.inner.isdisjoint(segment):
            return [i for part in pieces_apart(segment, self.inner) for i in self.encode(part)]
        name = self.name
        if segment.startswith(SPACE + SPACE):
            marks = len(segment) - len(segment.lstrip(SPACE))
            parts = []
            if marks < len(segment):
                parts = [name[p] for p in self.split(segment[marks - 1 :])]
                if parts[0] == SPACE:
                    parts = parts[1:]
                else:
                    marks -= 1
            lead = []
            while marks:
                size = next((r for r in self.runs if r <= marks), 1)
                lead.append(SPACE * size)
                marks -= size
            parts = lead + parts
        else:
            parts = [name[p] for p in self.split(segment)]
        if len(self.name) > self.fixed + 200_000:  # characters met are bounded by Unicode; keep them few
            self._forget()
        ids, normal = [], self.vocab.normal
        for p in parts:
            i = normal.get(p)
            if i is not None:
                ids.append(i)
            elif self.vocab.bytes:
                ids.extend(self.vocab.bytes[x] for x in p.encode("utf-8"))
            else:
                ids.append(self.vocab.unknown)
        return ids

    def _forget(self) -> None:
        for ch in self.name[self.fixed :]:
            del self.number[ch]
        for held in (self.name, self.born, self.left, self.right, self.shorter, self.plain):
            del held[self.fixed :]
        self.fits.clear()


class _Segments(dict):
    """Little-endian 32-bit ids by segment; misses are encoded, the size is bounded.

    Words met first are the frequent ones, so a full cache keeps what it has; after
    many misses more it starts anew, as the texts may have changed.
    """

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger
        self.missed = 0

    def __missing__(self, segment: str) -> bytes:
        out = array("I", self.merger.encode(SPACE + segment)).tobytes()
        if len(segment) <= CACHED_CHARS:
            self.missed += 1
            if self.missed > 6 * CACHED_SEGMENTS:
                self.clear()
                self.missed = 0
            if len(self) < CACHED_SEGMENTS:
                self[segment] = out
        return out


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.merger = Merger(self.vocab)
        self.cache = _Segments(self.merger)
        v = self.vocab
        self.text_of = [p.replace(SPACE, " ").encode("utf-8") for p in v.pieces]
        for i in v.silent:
            self.text_of[i] = b""
        if v.unknown >= 0:
            self.text_of[v.unknown] = " ⁇ ".encode()
        for i, b in v.byte_of.items():
            self.text_of[i] = bytes([b])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, segments(text or "")))

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin and end."""
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        ids = list(ids)
        joined = b"".join(map(self.text_of.__getitem__, ids))
        try:
            text = joined.decode("utf-8") if self.vocab.silent.isdisjoint(ids[1:-1]) else self._mended(ids)
        except UnicodeDecodeError:
            text = self._mended(ids)
        first = next((i for i in ids if i not in self.vocab.silent), None)
        if first is not None and self.vocab.pieces[first].startswith(SPACE):
            text = text[1:]
        return text

    def _mended(self, ids: list[int]) -> str:
        """Runs of byte pieces decoded one by one; an invalid byte is U+FFFD."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode("utf-8"))
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.vocab.byte_of:
                run.append(self.vocab.byte_of[i])
            else:
                flush()  # a control id, too, ends a run
                out.append(self.text_of[i].decode("utf-8"))
        flush()
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, made once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", ends: bool = True) -> DataFrame:
    """Add the ids of whole texts as ``ids`` (array<int>), with begin and end ids if ``ends``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            got = [np.frombuffer(c.encode_bytes(t), "<u4") for t in batch.column(text).to_pylist()]
            if ends:
                got = [np.concatenate(([c.vocab.begin], g, [c.vocab.end])) for g in got]
            sizes = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(g) for g in got], out=sizes[1:])
            flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield _with(batch, ids, column)

    return docs.mapInArrow(run, _schema_with(docs, ids, "array<int>"))


def decode(docs: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Add the text of ``ids`` (array<int>; null: empty) as ``text``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            yield _with(batch, text, pa.array([c.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string()))

    return docs.mapInArrow(run, _schema_with(docs, text, "string"))


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts with begin and end ids, decode those ids, and keep digests.

    Rows: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        begin, end = (i.to_bytes(4, "little") for i in (c.vocab.begin, c.vocab.end))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = begin + c.encode_bytes(t) + end
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back = c.decode(memoryview(ids).cast("I"))
                text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _schema_with(df: DataFrame, name: str, kind: str):
    """The schema of ``df`` with ``name`` last, in place of a column of that name."""
    from pyspark.sql import types as T

    field = T.StructType.fromDDL(f"`{name}` {kind}").fields[0]
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [field])


def _with(batch, name: str, column):
    """``batch`` with ``column`` last, in place of a column of that name."""
    import pyarrow as pa

    keep = [k for k, f in enumerate(batch.schema) if f.name.lower() != name.lower()]
    return pa.RecordBatch.from_arrays(
        [batch.column(k) for k in keep] + [column], [batch.schema[k].name for k in keep] + [name]
    )
