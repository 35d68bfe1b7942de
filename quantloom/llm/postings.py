"""Per-document frequencies in blocks, joined to a number for each distinct token.

A block is some MB of whole texts of one input partition. Its distinct tokens are dealt to buckets by hash, and a row
(block, bucket) holds them once with the documents that hold each and how often, as differences and frequencies in
integers of variable length. Tokens move to their buckets, where each distinct one is looked at once; the numbers
found go back to the blocks, where they are summed over the frequencies. So a token costs an entry per block that
holds it, however often it occurs, in both moves; no sum per document and bucket is made, and a frequent token is one
entry per block like others. There is a bucket for so many bytes of input, so that the distinct tokens of one fit in
memory at any size.

Results for odd input: an empty text has no token and sums of 0; a null id stays null; repeated rows are documents of
their own; a document longer than a block is a block; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import prefix_hash, run_starts, slices, span_hash, text_buffer

_CODED = "block bigint, bucket bigint, tokens binary, sizes binary, spread binary, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64())] + [(c, pa.binary()) for c in ("tokens", "sizes", "spread", "data")])

#: (bytes of the texts, their offsets) -> (all tokens in order, the row of each)
Split = Callable[[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]


def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values cut at the places ``at`` into one binary per run."""
    width = values.dtype.itemsize
    off = np.append(at, len(values)).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(values)]).cast(pa.binary())


def pack(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Numbers from 0 to 2**35 cut at the places ``at`` into one binary per run, seven bits to a byte, the lowest first."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(off[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > j)
        out[off[more] + j] = (values[more] >> 7 * j & 127) | np.where(size[more] > j + 1, 128, 0)
    return cut(out, off[at])


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that pack() packed, and where each row's begin (one entry more than rows)."""
    buf, off = text_buffer(col)
    last = buf < 128
    first = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(buf) else np.zeros(0, np.int64)
    place = np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf))))
    values = np.add.reduceat((buf & 127).astype(np.int64) << 7 * place, first) if len(first) else first
    return values, np.concatenate(([0], np.cumsum(last)))[off]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", most):
            held.append(part)
            size += part.column("text").nbytes
            if size >= most or sum(x.num_rows for x in held) >= 1 << 19:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pack(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Numbers from 0 to 2**35 cut at the places ``at`` into one binary per run, seven bits to a byte, the lowest first."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(off[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > j)
        out[off[more] + j] = (values[more] >> 7 * j & 127) | np.where(size[more] > j + 1, 128, 0)
    return cut(out, off[at])


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that pack() packed, and where each row's begin (one entry more than rows)."""
    buf, off = text_buffer(col)
    last = buf < 128
    first = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(buf) else np.zeros(0, np.int64)
    place = np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf))))
    values = np.add.reduceat((buf & 127).astype(np.int64) << 7 * place, first) if len(first) else first
    return values, np.concatenate(([0], np.cumsum(last)))[off]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", most):
            held.append(part)
            size += part.column("text").nbytes
            if size >= most or sum(x.num_rows for x in held) >= 1 << 19:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def distinct_tokens(rows: DataFrame, split: Split, block_bytes: int = 16 << 20) -> DataFrame:
    """(token): each once per block; the caller's distinct() makes it once over all."""
    def run(batches):
        for block in blocks(batches, block_bytes):
            tokens, _ = split(*text_buffer(block.column("text").chunk(0)))
            yield pa.RecordBatch.from_arrays([tokens.unique().cast(pa.binary())], ["token"])
    return rows.mapInArrow(run, "token binary")


def squeezed(col: pa.Array) -> pa.Array:
    """Each binary compressed by itself."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(x) for x in col.to_pylist()], pa.binary())


def restored(col: pa.Array, i: int) -> pa.Array:
    """Row i of a squeezed column."""
    return pa.array([zstandard.ZstdDecompressor().decompress(col[i].as_py())], pa.binary())


def bucket_count(rows: DataFrame, bucket_bytes: int = 8 << 20) -> int:
    """A bucket for every ``bucket_bytes`` of text."""
    return 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes


def coded_blocks(rows: DataFrame, split: Split, buckets: int, extra: Callable[[np.ndarray], np.ndarray] | None = None,
                 block_bytes: int = 16 << 20) -> DataFrame:
    """For (doc_id, text) rows the blocks' tokens and frequencies (block, bucket, tokens, sizes, spread, data).

    Bucket -1 of a block names its documents. ``extra`` gives an integer per document from the offsets. The binaries of
    buckets are compressed. The result must be written before it is used twice, so that blocks stay what they are when a task runs again.
    """
    def run(batches):
        task = TaskContext.get().partitionId()
        for seq, block in enumerate(blocks(batches, block_bytes)):
            n, key = block.num_rows, (task << 24) + seq
            ids = block.column("doc_id").chunk(0)
            buf, off = text_buffer(block.column("text").chunk(0))
            more = np.zeros(n, np.int64) if extra is None else extra(off).astype(np.int64)
            known = np.stack([np.asarray(ids.fill_null(0), np.int64), more, np.asarray(ids.is_valid(), np.int64)])
            yield pa.RecordBatch.from_pylist([{"block": key, "bucket": -1, "data": known.tobytes()}], schema=_ARROW)
            tokens, owner = split(buf, off)
            if not len(tokens):
                continue
            coded = tokens.dictionary_encode()
            letters, edge = text_buffer(coded.dictionary)
            bucket = (span_hash(prefix_hash(letters), edge[:-1], edge[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pair = rank[np.asarray(coded.indices)] * n + owner
            pair.sort()
            at = run_starts(pair)
            freq = np.diff(np.append(at, len(pair)))
            word, doc = pair[at] // n, pair[at] % n
            at = run_starts(word)
            step = np.diff(doc, prepend=0)
            step[at] = doc[at]
            letters, edge = text_buffer(coded.dictionary.take(pa.array(order)))
            begin = run_starts(bucket[order])
            for a in range(0, len(begin), 64):  # some rows at a time
                b = begin[a:a + 64]
                lo, hi = b[0], begin[a + 64] if a + 64 < len(begin) else len(order)
                first, last = at[lo], at[hi] if hi < len(at) else len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b), key)), pa.array(bucket[order[b]])] + [squeezed(x) for x in (
                        cut(letters[edge[lo]:edge[hi]], edge[b] - edge[lo]), pack(np.diff(edge[lo:hi + 1]), b - lo),
                        pack(np.diff(np.append(at[lo:hi], last)), b - lo),
                        pack(np.stack([step[first:last], freq[first:last]], axis=1).ravel(), 2 * (at[b] - first)))], schema=_ARROW)
    return rows.mapInArrow(run, _CODED)


def count_tokens(coded: DataFrame, look: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """(block, bucket, counts): ``look``'s number, not below 0, of each token, asked once per distinct token."""
    rows = coded.filter("bucket >= 0").select("block", "bucket", "tokens", "sizes").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        now, known = None, {}
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                edge = np.concatenate(([0], np.cumsum(unpack(restored(batch.column("sizes"), i))[0]))).tolist()
                data = restored(batch.column("tokens"), i)[0].as_py()
                tokens = [data[a:b] for a, b in zip(edge, edge[1:])]
                new = [t for t in tokens if t not in known]
                known.update(zip(new, look(new).tolist()))
                counts = pack(np.array([known[t] for t in tokens], np.int64), np.zeros(1, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), batch.column("bucket").slice(i, 1), counts], ["block", "bucket", "counts"])
    return rows.mapInArrow(run, "block bigint, bucket bigint, counts binary")


def sum_counts(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, extra, total): for each document the sum of count x frequency over its tokens, exact below 2**53."""
    both = (coded.select("block", "bucket", "spread", "data", F.lit(0).alias("kind"))
            .unionByName(counts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .repartition("block").sortWithinPartitions("block", "bucket", "kind"))

    def run(batches):
        docs, places, parts = None, [], []

        def done():
            if docs is not None:
                ids, extra, valid = docs
                total = np.zeros(len(ids)) if not places else np.bincount(np.concatenate(places), weights=np.concatenate(parts), minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(extra), pa.array(total.astype(np.int64))], ["doc_id", "extra", "total"])

        for batch in batches:
            for i, (bucket, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist())):
                if bucket < 0:
                    yield from done()
                    docs = np.frombuffer(batch.column("data")[i].as_py(), np.int64).reshape(3, -1)
                    places, parts = [], []
                elif kind == 0:
                    spread = unpack(restored(batch.column("spread"), i))[0]
                    found = unpack(restored(batch.column("data"), i))[0]
                    step, freq = found[::2], found[1::2]
                    # differences begin anew with each token
                    at = np.cumsum(spread) - spread
                    run_on = np.cumsum(step)
                    places.append((run_on - np.repeat(run_on[at] - step[at], spread)).astype(np.int32))
                else:
                    parts.append(np.repeat(unpack(batch.column("counts").slice(i, 1))[0], spread) * freq)
        yield from done()
    return both.mapInArrow(run, "doc_id bigint, extra bigint, total bigint")
