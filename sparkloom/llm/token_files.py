"""Token ids in files under a canonical length-limited Huffman code.

Method.  Documents are dealt to ranges in ascending key order and encoded; every
document ends in the end id.  The ids of all documents are counted, and package-merge
gives each id a code of at most ``LONGEST`` bits from these global counts.  Codes are
canonical, so the files keep code lengths only.

File format.  A folder with two tables.  ``codes``: id, bits.  ``blocks``, in folders
by range number (``part``) and in them by ``seq``: ``start`` (ids before the block),
``keys`` and ``sizes`` (documents and their numbers of ids), ``payload`` (codes, most
significant bit first) and ``marks`` (the bit at which each ``MARK_EVERY``-th id
starts).  A block can be decoded by itself, and from each mark by itself; decoding
steps through all marks of many blocks at once with one table lookup an id.

Defined results: null and empty texts hold the end id alone.  Special strings inside
texts become their special ids, as ``tokenizers`` does by default.  Documents with
null keys come first; repeated keys are in an order of their texts.  Very long texts are
encoded like others; a block ends behind one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._byte_level import byte_level
from sparkloom.llm.common import discard, lots, materialise, scratch_path
from sparkloom.llm.ordered import in_order

#: Bits of the longest code, ids between marks, ids in a block (about).
LONGEST, MARK_EVERY, BLOCK_IDS = 16, 512, 80_000


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol by package-merge; 0 for symbols that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(n))))
    order = used[np.lexsort((used, counts[used]))]
    single = counts[order].astype(np.float64)
    # in each round the packages of the round before are merged with the symbols;
    # what counts for the lengths is how many symbols are among the first so many
    rounds: list[np.ndarray] = []
    weights = single
    rounds.append(np.ones(n, bool))
    for _ in range(longest - 1):
        m = len(weights) // 2
        packs = weights[: 2 * m].reshape(m, 2).sum(axis=1)
        both = np.concatenate([single, packs])
        at = np.argsort(both, kind="stable")
        rounds.append(at < n)
        weights = both[at]
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_symbol in reversed(rounds):
        symbols = int(is_symbol[:take].sum())
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, id)."""
    codes = np.zeros(len(bits), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    for length in np.unique(bits[order]):
        group = order[bits[order] == length]
        code <<= int(length) - last
        codes[group] = code + np.arange(len(group), dtype=np.uint32)
        code += len(group)
        last = int(length)
    return codes


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids one after another, and the bit at which every ``MARK_EVERY``-th starts."""
    size = bits[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 2, np.uint32)
    if len(ids):
        word, shift = at >> 5, 64 - (at & 31) - size
        value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
        low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[starts]] = np.bitwise_or.reduceat(high, starts)
        over = np.flatnonzero(low)
        words[word[over] + 1] |= low[over]
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::MARK_EVERY]


class Decoder:
    """A table with the id and the bits for every window of the longest code's length."""

    def __init__(self, bits: np.ndarray):
        self.window = max(1, int(bits.max(initial=1)))
        codes = canonical_codes(bits)
        self.ids = np.zeros(1 << self.window, np.uint32)
        self.step = np.ones(1 << self.window, np.int64)
        order = np.flatnonzero(bits)
        free = self.window - bits[order].astype(np.int64)
        first = codes[order].astype(np.int64) << free
        for k in np.unique(free):
            some = order[free == k]
            cells = (first[free == k][:, None] + np.arange(1 << int(k))[None, :]).reshape(-1)
            self.ids[cells] = np.repeat(some, 1 << int(k))
            self.step[cells] = self.window - int(k)

    def blocks(self, payloads: list[bytes], marks: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """The ids of blocks; all marks of all blocks are followed side by side."""
        whole = [p + b"\0" * (-len(p) % 4 + 8) for p in payloads]
        words = np.frombuffer(b"".join(whole), ">u4").astype(np.uint64)
        pairs = words.copy()
        pairs <<= np.uint64(32)
        pairs[:-1] |= words[1:]
        base = np.concatenate(([0], np.cumsum([len(w) * 8 for w in whole])))[:-1]
        at = np.concatenate([m + b for m, b in zip(marks, base)]) if marks else np.zeros(0, np.int64)
        out = np.zeros((MARK_EVERY, len(at)), np.uint32)
        top = 64 - self.window
        mask = np.uint64((1 << self.window) - 1)
        limit = len(words) - 1
        for k in range(min(MARK_EVERY, max(sizes, default=0))):
            seen = ((pairs[np.minimum(at >> 5, limit)] >> (top - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[k] = self.ids[seen]
            at = at + self.step[seen]
        lanes = np.ascontiguousarray(out.T).reshape(-1)
        got, lane = [], 0
        for m, n in zip(marks, sizes):
            got.append(lanes[lane * MARK_EVERY : lane * MARK_EVERY + n])
            lane += len(m)
        return got


def write(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Encode whole texts and write them below ``path``."""
    spark = docs.sparkSession
    dealt, _ = in_order(docs, key, text)
    vocab_size = byte_level(vocabulary).size
    width = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder, stop = byte_level(vocabulary), np.array([end], np.uint32)
        keys, sizes, ids, held, seq, before, part = [], [], [], 0, 0, 0, 0

        def block() -> pa.RecordBatch:
            body = np.concatenate(ids).astype(width).tobytes()
            rows = [[part], [seq], [before], [keys], [sizes], [body]]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names)

        for batch in lots(batches, 3):
            parts, doc_keys, texts = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for p, k, got in zip(parts, doc_keys, coder.encode(texts)):
                part = p
                keys.append(k)
                sizes.append(len(got) + 1)
                ids += (got, stop)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield block()
                    seq, before = seq + 1, before + held
                    keys, sizes, ids, held = [], [], [], 0
        if keys:
            yield block()

    import pyarrow as pa

    names = ["part", "seq", "before", "keys", "sizes", "ids"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    encoded = dealt.mapInArrow(encode, "part int, seq int, before bigint, keys array<bigint>, sizes array<int>, ids binary")
    tokens = materialise(encoded, "token-ids")

    def count(batches: Iterator) -> Iterator:
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for body in batch.column(0):
                total += np.bincount(np.frombuffer(body.as_buffer(), width), minlength=vocab_size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocab_size, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    bits = code_lengths(counts)
    used = np.flatnonzero(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = {r.part: r.n for r in tokens.groupBy("part").agg(F.sum(size).alias("n")).collect()}
    starts, run = {}, 0
    for p in sorted(totals):
        starts[p], run = run, run + totals[p]
    shipped = spark.sparkContext.broadcast((bits, canonical_codes(bits), starts))

    def compress(batches: Iterator) -> Iterator:
        bits, codes, starts = shipped.value
        for batch in batches:
            part, seq, before, keys, sizes, ids = batch.columns
            packed = [pack(np.frombuffer(b.as_buffer(), width), bits, codes) for b in ids]
            start = [starts[p] + b for p, b in zip(part.to_pylist(), before.to_pylist())]
            marks = pa.array([m.tolist() for _, m in packed], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part, seq, pa.array(start, pa.int64()), keys, sizes, pa.array([p for p, _ in packed], pa.binary()), marks],
                ["part", "seq", "start", "keys", "sizes", "payload", "marks"],
            )

    blocks = tokens.mapInArrow(
        compress, "part int, seq int, start bigint, keys array<bigint>, sizes array<int>, payload binary, marks array<bigint>"
    )
    blocks.sortWithinPartitions("part", "seq").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(tokens)


def read(spark: SparkSession, path: str, ids: bool = True, key: str = "doc_id") -> DataFrame:
    """Documents from files: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    codes = spark.read.schema("id int, bits int").parquet(f"{path}/codes").toPandas()
    bits = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.uint8)
    bits[codes["id"].to_numpy()] = codes["bits"].to_numpy()
    shipped = spark.sparkContext.broadcast(bits)

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = Decoder(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 48):
                start, keys, sizes, payload, marks = (c.to_pylist() for c in batch.slice(at, 48).columns)
                got = decoder.blocks(payload, [np.array(m, np.int64) for m in marks], [sum(s) for s in sizes])
                rows: list[tuple] = []
                for first, ks, ns, body in zip(start, keys, sizes, got):
                    ends = np.cumsum([0, *ns])
                    for k, a, b in zip(ks, ends[:-1].tolist(), ends[1:].tolist()):
                        own = body[a:b].astype("<u4")
                        rows.append((k, first + a, b - a, zlib.crc32(own.tobytes()), own.tolist() if ids else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * ids
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    layout = "seq int, start bigint, keys array<bigint>, sizes array<int>, payload binary, marks array<bigint>, part int"
    blocks = spark.read.schema(layout).parquet(f"{path}/blocks")
    return blocks.select("start", "keys", "sizes", "payload", "marks").mapInArrow(decode, schema)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Write documents to a scratch folder and read the files back, without the ids themselves."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, vocabulary, path, key, text, end)
    return read(docs.sparkSession, path, False, key)
