"""Removal of byte strings that stand more than once in a corpus.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. Windows of that length are
never sorted: the smallest hash of the 64-byte strings in a window is its anchor, equal windows have equal anchors,
and neighbouring windows with the same anchor are one run.

1. Runs are counted by the hash of all bytes that they span. Where a run occurs again as a whole, all its windows do.
2. An anchor with several different runs may have windows in common between them. One run of each kind is cut into
   pieces, windows that hold their first anchor at nearly the same place. Equal windows are of pieces with the same
   bytes in what all windows of a piece span, so only pieces that share these with another are taken apart into their
   windows, weighted by how often the kind occurs, and these are counted. So is a run that holds its anchor twice, as
   its windows may equal each other.
3. Covered bytes go back to all runs of a kind, and from there to the documents.

A group of copies is one row per kind of run after the first count, which combines in the task before the shuffle.

Results for odd input: a null or empty text has no bytes, nothing removed and the hash of no bytes; texts shorter
than ``length`` stay; a null id gives a row with a null id; repeated rows are copies, so their long texts go in
all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import discard, prefix_hash, run_starts, slices, span_hash, text_buffer, text_rows, write_out


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    anchor: int = 64
    #: windows of a piece hold their first anchor within so many bytes
    piece: int = 20
    slice_bytes: int = 2 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two prefix hashes of the same bytes."""
    return prefix_hash(buf), prefix_hash(buf ^ np.uint8(0xA5))


def find_runs(rows: DataFrame, rule: Repeats) -> DataFrame:
    """(row, first, last, anchor, h1, h2, twice): runs of windows that start at first to last."""
    names = ["row", "first", "last", "anchor", "h1", "h2", "twice"]

    def run(batches):
        n_k = rule.length - rule.anchor + 1
        for batch in batches:
            for part in slices(batch, "text", rule.slice_bytes):
                buf, off = text_buffer(part.column("text"))
                if len(buf) < rule.length:
                    continue
                p1, p2 = _hash(buf)
                at = np.arange(len(buf) - rule.anchor + 1)
                grams = span_hash(p1, at, at + rule.anchor)
                least = sliding_min(grams, n_k)
                s = np.arange(len(least))
                doc = np.searchsorted(off, s, side="right") - 1
                good = s + rule.length <= off[doc + 1]
                s, doc, least = s[good], doc[good], least[good]
                if not len(s):
                    continue
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
                begin = np.flatnonzero(new)
                first, last = s[begin], s[np.append(begin[1:], len(s)) - 1]
                key, doc = least[begin], doc[begin]
                # how often the anchor stands in what the run spans
                size = last - first + n_k
                edge = np.concatenate(([0], np.cumsum(size)))[:-1]
                inside = np.arange(size.sum()) + np.repeat(first - edge, size)
                twice = np.add.reduceat((grams[inside] == np.repeat(key, size)).astype(np.int32), edge) > 1
                end = last + rule.length
                row = np.asarray(part.column("row"))[doc]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((first - off[doc]).astype(np.int32)), pa.array((last - off[doc]).astype(np.int32)), pa.array(key.view(np.int64)),
                                                  pa.array(span_hash(p1, first, end).view(np.int64)), pa.array(span_hash(p2, first, end).view(np.int64)), pa.array(twice)], names)
    return rows.mapInArrow(run, "row bigint, first int, last int, anchor bigint, h1 bigint, h2 bigint, twice boolean")


def _beside_text(rows: DataFrame, parts: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of the text's two prefix hashes and the columns of ``parts`` that name its row."""
    names, given = [c.split()[0] for c in schema.split(", ")], parts.columns
    texts = rows.join(parts.select("row").distinct(), "row", "left_semi").select("row", "text", F.lit(0).alias("kind"))
    both = texts.unionByName(parts.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "kind")

    def run(batches):
        now = p1 = p2 = None
        for batch in batches:
            row, kind = np.asarray(batch.column("row")), np.asarray(batch.column("kind"))
            at = run_starts(row)
            for a, b in zip(at, np.append(at[1:], len(row))):
                if kind[a] == 0:
                    now, (p1, p2) = row[a], _hash(text_buffer(batch.column("text").slice(a, 1))[0])
                    a += 1
                if a == b:
                    continue
                if row[a] != now:
                    raise ValueError("a run without its text")
                columns = work(p1, p2, {c: np.asarray(batch.column(c).slice(a, b - a)) for c in given})
                yield from pa.Table.from_arrays([pa.array(x) for x in columns], names).to_batches(max_chunksize=50_000)
    return both.mapInArrow(run, schema)


def cut_runs(rows: DataFrame, kinds: DataFrame, rule: Repeats) -> DataFrame:
    """(key, n, row, first, skip, last): the pieces of one run of each kind (row, first, last, anchor, n).

    A piece is the windows from ``first`` + ``skip`` to ``last``; ``key`` is the hash of the bytes that all of them hold.
    """
    n_k = rule.length - rule.anchor + 1

    def work(p1, p2, run):
        first = run["first"].astype(np.int64)
        size = run["last"] - first + n_k  # places in the run where an anchor may stand
        edge = np.cumsum(size) - size
        whose = np.repeat(np.arange(len(first)), size)
        place = np.arange(size.sum()) - edge[whose]
        s = place + first[whose]
        hit = span_hash(p1, s, s + rule.anchor).view(np.int64) == run["anchor"][whose]
        at = np.arange(len(s))
        # every window holds an anchor, so the next one is in its run
        following = np.minimum.accumulate(np.where(hit, at, len(s))[::-1])[::-1]
        window = place <= size[whose] - n_k
        whose, place, s, behind = (x[window] for x in (whose, place, s, following - at))
        part = behind // rule.piece
        anchor = s + behind
        new = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        end = np.append(new[1:], len(s)) - 1
        low = part[new] * rule.piece
        high = np.minimum(low + rule.piece, n_k) - 1
        key = span_hash(p1, anchor[new] - low, anchor[new] - high + rule.length)
        return (key.view(np.int64), run["n"][whose[new]], run["row"][whose[new]], first[whose[new]].astype(np.int32),
                place[new].astype(np.int32), s[end].astype(np.int32))
    return _beside_text(rows, kinds, work, "key bigint, n bigint, row bigint, first int, skip int, last int")


def split_runs(rows: DataFrame, pieces: DataFrame, rule: Repeats) -> DataFrame:
    """(w1, w2, n, row, first, place): the windows of pieces (row, first, skip, last, n)."""
    def work(p1, p2, run):
        begin = run["first"].astype(np.int64) + run["skip"]
        size = run["last"] - begin + 1
        whose = np.repeat(np.arange(len(begin)), size)
        s = np.arange(size.sum()) - (np.cumsum(size) - size)[whose] + begin[whose]
        first = run["first"][whose]
        return (*(span_hash(p, s, s + rule.length).view(np.int64) for p in (p1, p2)), run["n"][whose], run["row"][whose], first, (s - first).astype(np.int32))
    return _beside_text(rows, pieces, work, "w1 bigint, w2 bigint, n bigint, row bigint, first int, place int")


def covered_starts(rows: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """(row, first, places): runs (starting at ``first``) with repeated windows, all of them or those at ``places``."""
    runs = write_out(find_runs(rows, rule), "runs")
    one = F.struct("row", "first", "last")
    kinds = write_out(runs.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(one).alias("one")), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice")).filter("kinds > 1 or twice").select("anchor")
    # a kind found twice is covered whichever of its windows others have, but counts for theirs
    parts = kinds.join(several, "anchor", "left_semi").select("one.*", "anchor", "n")
    pieces = write_out(cut_runs(rows, parts, rule), "pieces")
    # pieces of kinds found twice are covered anyway
    shared = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"), F.min("n").alias("least")).filter("pieces > 1 and least = 1").select("key")
    windows = write_out(split_runs(rows, pieces.join(shared, "key", "left_semi").drop("key"), rule), "windows")
    discard(pieces)
    again = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    places = write_out(windows.filter("n = 1").join(again, ["w1", "w2"], "left_semi").groupBy("row", "first").agg(F.collect_list("place").alias("places")), "places")
    discard(windows)
    some = kinds.select("one.row", "one.first", "h1", "h2").join(places, ["row", "first"]).select("h1", "h2", "places")
    found = kinds.filter("n > 1").select("h1", "h2", F.lit(None).cast("array<int>").alias("places")).unionByName(some)
    return runs.join(found, ["h1", "h2"]).select("row", "first", "last", "places")


def _spans(first, last, places, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal covered runs."""
    a = np.concatenate([np.array([f]) if p is None else f + np.asarray(p) for f, p in zip(first, places)])
    b = np.concatenate([np.array([e]) if p is None else f + np.asarray(p) for f, e, p in zip(first, last, places)]) + length
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(b)) - 1]


def remove_repeats(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document, and with ``keep_text`` the kept bytes."""
    rows = write_out(text_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows")
    covers = covered_starts(rows, rule).groupBy("row").agg(F.collect_list(F.struct("first", "last", "places")).alias("runs"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist()):
                data = text.as_py().encode()
                starts, ends = _spans(*zip(*((r["first"], r["last"], r["places"]) for r in runs)), rule.length) if runs else ((), ())
                kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(starts),
                            "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if keep_text else {}))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                                                    ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if keep_text else [])))
    return rows.join(covers, "row", "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
