"""Byte-level BPE files of ``tokenizers``, encoded piece by piece.

Texts are cut where one pre-token of the byte-level pattern ends and the next begins
whatever stands around: before a blank that a character other than white space
follows, between a word and a mark or line end, between a mark and a line end, between
a line end and a word.  So the ids of a text are those of its pieces one after another.
The library encodes each piece, with its own pre-tokeniser; pieces seen before come
from a compact table of bounded size.  Texts with special strings go to the library
whole.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from sparkloom.llm._table import KEY_BYTES, Table, keys, padded

#: Pieces in a worker's table, bytes cut and looked up at a time (more where one text is longer).
ENTRIES, LOT = 1 << 20, 500_000


def _bytes(of: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_WORD = _bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_MARK = _bytes(b",.;:!?*&)\n")
_STOP = _bytes(b".!?")
#: Bytes that can start white space.
_SPACE = _bytes(bytes([*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]))
_PLAIN = _bytes(range(33, 127))
#: First bytes of two-byte letters, and the two-byte characters among these that are none.
_LEADS = _bytes(bytes([0xC3, 0xCE, 0xCF, 0xD0, 0xD1]))
_NO_LETTER = np.array([0xC397, 0xC3B7, 0xCE82, 0xCE83, 0xCE84, 0xCE85, 0xCE87, 0xCE8B, 0xCE8D, 0xCEA2, 0xCFB6], np.int64)


def cuts(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start, in texts one after another that start at ``first``."""
    n = int(first[-1])
    here, after = buf[:n], buf[1 : n + 1]
    before = np.concatenate((np.zeros(2, np.uint8), buf[:n]))
    one, two = before[1 : n + 1], before[:n]
    cut = np.zeros(n + 1, bool)
    cut[:n] = (here == 32) & ~_SPACE[after]
    marks = np.flatnonzero(_MARK[here])
    lead, last = two[marks].astype(np.int64), one[marks]
    letter = _LEADS[lead] & (last >= 128) & (last < 192) & ~np.isin(lead << 8 | last, _NO_LETTER)
    cut[marks] = _WORD[last] | letter | ((here[marks] == 10) & _STOP[last])
    lines = np.flatnonzero(one == 10)
    cut[lines] |= _PLAIN[two[lines]] & _WORD[here[lines]]
    # a text's last character has nothing behind it, its first nothing before it
    ends = first[1:] - 1
    cut[ends[here[ends] == 32] if n else ends[:0]] = False
    cut[first] = True
    return np.flatnonzero(cut[:n]) if n else np.zeros(0, np.int64)


class ByteLevel:
    """A byte-level file without normalizer and prefix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("normalizer"):
            raise ValueError("only byte-level files without normalizer and prefix can be cut into pieces")
        added = model.get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in what is around them are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self._table = Table(ENTRIES)
        self._ids = np.zeros(4 * ENTRIES, np.uint32)
        self._end = np.zeros(ENTRIES + 1, np.int64)

    def whole(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A padded buffer, where pieces begin and end in it, and each text's first piece (one more at the end)."""
        buf, first = padded([t.encode("utf-8", "surrogatepass") for t in texts])
        begin = cuts(buf, first)
        return buf, begin, np.append(begin[1:], first[-1]), np.searchsorted(begin, first)

    def library_ids(self, pieces: list[str]) -> list[list[int]]:
        # one at a time: batches hold all their encodings at once and start a thread for each core, in every worker
        return [self.library.encode(p, add_special_tokens=False).ids for p in pieces]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        lot: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if t and self.whole(t):
                out[k] = np.array(self.library_ids([t])[0], np.uint32)
            elif t:
                lot.append(k)
                size += len(t)
                if size > LOT:
                    self._lot(texts, lot, out)
                    lot, size = [], 0
        if lot:
            self._lot(texts, lot, out)
        return out

    def _lot(self, texts: list[str], lot: list[int], out: list[np.ndarray]) -> None:
        buf, begin, end, first = self.pieces([texts[k] for k in lot])
        short = np.flatnonzero(end - begin <= KEY_BYTES)
        found = np.full(len(begin), -1, np.int64)
        k = keys(buf, begin[short], end[short])
        found[short] = self._table.find(k)
        lacking = np.flatnonzero(found < 0)
        raw = buf.tobytes()
        names = [raw[a:b] for a, b in zip(begin[lacking].tolist(), end[lacking].tolist())]
        place = {p: i for i, p in enumerate(dict.fromkeys(names))}
        got = self.library_ids([p.decode("utf-8", "surrogatepass") for p in place])
        size = np.fromiter(map(len, got), np.int64, len(got))
        new = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        # pieces of this lot that are not held stand behind those that are
        held = self._table.held
        room, ids, ends = int(self._end[held]), self._ids, self._end
        if room + len(new) <= len(ids) and held + len(size) < len(ends):
            # the free room of the table takes them for now
            ids[room : room + len(new)] = new
            ends[held + 1 : held + 1 + len(size)] = room + np.cumsum(size)
        else:
            ids = np.concatenate([ids[:room], new])
            ends = np.concatenate([ends[: held + 1], room + np.cumsum(size)])
        found[lacking] = held + np.fromiter((place[p] for p in names), np.int64, len(names))
        start, many = ends[found], ends[found + 1] - ends[found]
        total = np.concatenate(([0], np.cumsum(many)))
        flat = ids[np.repeat(start - total[:-1], many) + np.arange(int(total[-1]))]
        for k, a, b in zip(lot, total[first[:-1]].tolist(), total[first[1:]].tolist()):
            out[k] = flat[a:b]
        self._keep(list(place), size, new)

    def _keep(self, names: list[bytes], size: np.ndarray, new: np.ndarray) -> None:
        """Hold the short ones of new pieces; what was held is forgotten if there is no room."""
        some = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) <= KEY_BYTES)
        if len(some) > ENTRIES:
            return
        starts = np.cumsum(size) - size
        many = int(size[some].sum())
        if self._table.held + len(some) > ENTRIES or self._end[self._table.held] + many > len(self._ids):
            self._table.clear()
        if many > len(self._ids):
            return
        held = self._table.held
        ends = np.cumsum(size[some])
        buf, first = padded([names[i] for i in some.tolist()])
        self._table.add(keys(buf, first[:-1], first[1:]), held + np.arange(len(some)))
        flat = new[np.repeat(starts[some] - (ends - size[some]), size[some]) + np.arange(many)]
        self._ids[self._end[held] : self._end[held] + many] = flat
        self._end[held + 1 : held + 1 + len(some)] = self._end[held] + ends


_READERS: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    """The reader of a vocabulary file, made once in each worker."""
    if path not in _READERS:
        _READERS[path] = ByteLevel(path)
    return _READERS[path]
