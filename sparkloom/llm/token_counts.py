"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

Method.  A text is cut where no token can span: for sentencepiece models before runs
of space marks, for byte-level ``tokenizers`` files where pre-tokens meet.  The number
of tokens of a text is the sum over its pre-tokens.  Tier one is a compact broadcast
hash table of frequent pre-tokens and their token counts, fitted on a bounded sample of
documents (it only saves time: any table gives the same counts) and never changed.
Tier two is a bounded table in each worker; what both lack is encoded by the library,
all misses of a lot together.  Both are looked up for all pre-tokens of a lot at once.

Defined results: null and empty texts have 0 tokens and 0 bytes.  Special strings
inside texts are treated as the library does by default: ordinary text for
sentencepiece, one special token for ``tokenizers``.  Texts of any length are taken in
slices of a bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._byte_level import ByteLevel, byte_level
from sparkloom.llm._pieces import SPACE
from sparkloom.llm._table import KEY_BYTES, Table, keys, padded
from sparkloom.llm.common import bounded_rows, lots

#: Tier one: rows sampled to fit it, and entries.  Tier two: entries in a worker's table.
SAMPLE_ROWS, TABLE_ENTRIES, CACHE_ENTRIES = 2_000, 32_768, 1 << 20
#: Bytes of a text that are cut at a time.
SLICE = 4_000_000


class Pieces:
    """Pre-tokens and their token counts for a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # cutting at blanks is right only if no piece holds a mark after a letter
        if any(re.search(f"[^{SPACE}]{SPACE}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())):
            raise ValueError("this model has pieces across word boundaries")

    def extra(self, text: str) -> int | None:
        return None

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A padded buffer, where segments begin and end in it, each text's first segment (one more at the end).

        A run of blanks starts a segment, which is given without the first of them: the
        library puts a mark in front by itself.  A text's first segment is given whole.
        """
        mark = SPACE.encode()
        buf, first = padded([t.encode("utf-8", "surrogatepass").replace(mark, b" ") for t in texts])
        n = int(first[-1])
        blank = buf[:n] == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        lead = first[:-1][first[:-1] < first[1:]]
        opens[lead] = False  # blanks at a text's start belong to its first segment
        runs = np.flatnonzero(opens)
        begin = np.concatenate([lead, runs + 1])
        stop = np.concatenate([lead, runs])
        order = np.argsort(stop, kind="stable")
        begin, stop = begin[order], stop[order]
        end = np.append(stop[1:], n)
        return buf, begin, end, np.searchsorted(stop, first)

    def count(self, parts: list[bytes]) -> list[int]:
        """The library puts the first mark in front by itself; it writes nothing for no text."""
        got = self.model.encode([p.decode("utf-8", "replace") for p in parts], num_threads=1)
        return [len(ids) if p else 1 for p, ids in zip(parts, got)]

    def slices(self, body: str) -> Iterator[str]:
        """Parts of a long text, cut at runs of blanks, whose segments are those of the text."""
        at = 0
        while len(body) - at > SLICE and (run := _RUN.search(body, at + SLICE)) and run.end() < len(body):
            yield body[at : run.start()]
            at = run.start() + 1
        yield body[at:] if at else body


_RUN = re.compile(f"(?<![ {SPACE}])[ {SPACE}](?=.)", re.DOTALL)


class Bytes:
    """Pre-tokens and their token counts for a byte-level BPE file of ``tokenizers``."""

    def __init__(self, path: str):
        self.model: ByteLevel = byte_level(path)

    def extra(self, text: str) -> int | None:
        """The count of a text with special strings, which is not cut."""
        return len(self.model.library_ids([text])[0]) if self.model.whole(text) else None

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.model.pieces(texts)

    def count(self, parts: list[bytes]) -> list[int]:
        return [len(ids) for ids in self.model.library_ids([p.decode("utf-8", "surrogatepass") for p in parts])]

    def slices(self, body: str) -> Iterator[str]:
        yield body


_READERS: dict[str, Pieces | Bytes] = {}


def reader(path: str) -> Pieces | Bytes:
    """The reader of a vocabulary file, made once in each worker."""
    if path not in _READERS:
        _READERS[path] = Pieces(path) if path.endswith(".model") else Bytes(path)
    return _READERS[path]


def frequent(docs: DataFrame, vocabulary: str, key: str, text: str) -> Table:
    """Tier one: frequent pre-tokens of a bounded sample with their counts.

    Tasks of the scan count the sample's pre-tokens and send on at most
    ``TABLE_ENTRIES`` each; the driver keeps as many.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        r, seen = reader(vocabulary), Counter()
        for batch in lots(batches, 0):
            buf, begin, end, _ = r.cut([t for t in batch.column(0).to_pylist() if t])
            some = end - begin <= KEY_BYTES
            raw = buf.tobytes()
            seen.update(raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist()))
            if len(seen) > 20 * TABLE_ENTRIES:
                seen = Counter(dict(seen.most_common(10 * TABLE_ENTRIES)))
        top = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["part", "n"]
        )

    sample = bounded_rows(docs.select(key, text), key, SAMPLE_ROWS, "token-counts").select(text)
    few = sample.mapInArrow(run, "part binary, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    top = [bytes(row.part) for row in few.orderBy(F.desc("n"), "part").limit(TABLE_ENTRIES).collect()]
    table = Table(max(1, len(top)))
    if top:
        table.add(_keys_of(top), np.array(reader(vocabulary).count(top)))
    return table


def _keys_of(parts: list[bytes]) -> np.ndarray:
    buf, first = padded(parts)
    return keys(buf, first[:-1], first[1:])


class Counts:
    """Counts of pre-tokens: tier one, then this worker's table, then the library."""

    def __init__(self, vocabulary: str, frequent: Table):
        self.reader, self.one = reader(vocabulary), frequent
        self.two = Table(CACHE_ENTRIES)

    def of(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        who: list[int] = []
        bodies: list[str] = []
        size = 0
        for k, t in enumerate(texts):
            extra = self.reader.extra(t) if t else 0
            if extra is not None:
                out[k] = extra
                continue
            for part in self.reader.slices(t):
                who.append(k)
                bodies.append(part)
                size += len(part)
                if size > SLICE:
                    np.add.at(out, who, self._sums(bodies))
                    who, bodies, size = [], [], 0
        if who:
            np.add.at(out, who, self._sums(bodies))
        return out

    def _sums(self, texts: list[str]) -> np.ndarray:
        buf, begin, end, first = self.reader.cut(texts)
        n = np.full(len(begin), -1, np.int64)
        short = np.flatnonzero(end - begin <= KEY_BYTES)
        k = keys(buf, begin[short], end[short])
        n[short] = self.one.find(k)
        left = n[short] < 0
        n[short[left]] = self.two.find(k[left])
        lacking = np.flatnonzero(n < 0)
        raw = buf.tobytes()
        names = [raw[a:b] for a, b in zip(begin[lacking].tolist(), end[lacking].tolist())]
        new = dict.fromkeys(names)
        new = dict(zip(new, self.reader.count(list(new)))) if new else new
        n[lacking] = np.fromiter(map(new.__getitem__, names), np.int64, len(names))
        held = [p for p in new if len(p) <= KEY_BYTES]
        if held and len(held) <= CACHE_ENTRIES:
            if self.two.held + len(held) > CACHE_ENTRIES:
                self.two.clear()
            self.two.add(_keys_of(held), np.fromiter(map(new.__getitem__, held), np.int64, len(held)))
        total = np.concatenate(([0], np.cumsum(n)))
        return total[first[1:]] - total[first[:-1]]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """Rows: ``key``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    One pass over the documents; one row for each input row, repeated rows included.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, key, text))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counts = Counts(vocabulary, shipped.value)
        for batch in lots(batches, 1):
            n = counts.of(batch.column(1).to_pylist())
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
