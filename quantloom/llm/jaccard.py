"""Exact join of word sets within a Jaccard distance, in the metric space of the sets.

A document is the set of its distinct 5-word shingles (64-bit hashes); equal sets are one point. All links within
the distance are found by regions around pivots:

1. The first pivots are the single shingles. Every set lies nearest to the pivots of its own shingles, and among
   those in the region of the one that comes first in a fixed order of all shingles (those in few documents first).
   A set within the distance lacks at most a fifth of the shingles, so a set is replicated to the regions of its
   first fifth and one more: then two linked sets share the region of their first common shingle. From its place in
   both follows how large the other may be, and a region falls apart where sizes leave a gap.
2. For each set a sketch is kept: how many of its shingles fall into each part of the hash's range, of
   as many parts as it has shingles, up to a power of two. Counts of neighbouring parts add up to those of a coarser
   sketch, so sets of different sizes compare; a region is measured as coarsely as its smallest set. The distance of
   sketches, 1 - sum of least counts / sum of largest counts, is a metric and never more than that of the
   sets, so what it tells apart is not linked. Only sets that it leaves together are sent in full.
3. In each region the smallest set, of equal ones that with the smallest hash, is the region's pivot. Regions with the same pivot are one. The
   sketches' distance of every member to its pivot is measured as members stream past it; a pivot with many members
   is sent to several tasks.
4. Members whose exact distance is within it are linked to the pivot, so they need not be compared with each other. By the
   triangle inequality two members can be linked only if their distances to the pivot differ by no more than the
   distance: a region falls into rings as wide as that, and every two neighbouring rings are a group.
   Groups whose members all are in one component are done; small ones are compared directly, member by member of
   different components, of those that by their sketches may be linked; larger ones are regions again with a pivot of their own, without the old one.

Each round tests all pairs with its pivots, so rounds end; what is left after ``max_rounds``, and a group that
its pivot did not part, is compared block against block. No pair is dropped and no group is expanded into its pairs.

Results for odd input: a null, empty or blank text has an empty set, is linked with nothing and is its own
component; with fewer than five words the whole sequence is the one shingle; a null id takes part in its class
and has a null component only where no row of the component has an id; repeated rows are copies; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import WORD_SPACE, discard, mix64, prefix_hash, slices, span_hash, text_buffer, text_rows, words_in, write_out
from quantloom.llm.components import components

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Join:
    words: int = 5
    #: linked: 100 * common >= percent * all
    percent: int = 80
    #: counters by which shingles in many documents come last
    counter_bits: int = 21
    #: groups of at most so many members, whose sketches have at most so many counts, are compared directly
    leaf: int = 1024
    leaf_counts: int = 1 << 20
    #: members that one task measures against a pivot
    members: int = 400
    max_rounds: int = 4
    filter_bits: int = 24
    #: a sketch has at least and at most two to these powers of counts
    sketch_bits: tuple[int, int] = (6, 18)
    slice_bytes: int = 4 << 20


def shingle_sets(batch: pa.RecordBatch, join: Join) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row with a word."""
    buf, off = text_buffer(batch.column("text"))
    starts, ends, row = words_in(buf, off)
    if not len(starts):
        return
    lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    h = span_hash(prefix_hash(lower), starts, ends)
    n, k = len(h), join.words
    roll = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        roll = roll * _ODD + h[j:n - k + 1 + j] if n >= k else roll
    roll = mix64(roll)
    at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for r in range(batch.num_rows):
        a, b = at[r], at[r + 1]
        if b - a >= k:
            yield r, np.unique(roll[a:b - k + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = whole * _ODD + x
            yield r, mix64(whole ^ np.uint64(0x5851F42D4C957F2D))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set; the first names it."""
    return int(mix64(s).sum(dtype=np.uint64).view(np.int64)), int(mix64(s * _ODD + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64))


def with_sets(rows: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n, point, check) per document; rows with a null point hold counters of how often shingles occur."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("point", pa.int64()), ("check", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
    size = 1 << join.counter_bits

    def run(batches):
        counts = np.zeros(size, np.int32)
        some = False
        for batch in batches:
            for part in slices(batch, "text", join.slice_bytes):
                ids = part.column("doc_id").to_pylist()
                out = {r: (0, 0, 0) for r in range(part.num_rows)}
                held = []
                for r, s in shingle_sets(part, join):
                    out[r] = (len(s), *set_id(s))
                    held.append(s >> np.uint64(64 - join.counter_bits))
                if held:
                    some = True
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=size).astype(np.int32)
                n, point, check = (np.array(x, np.int64) for x in zip(*(out[r] for r in range(part.num_rows))))
                none = pa.nulls(len(n), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(point), pa.array(check), none, pa.nulls(len(n), pa.binary())], schema=schema)
        if some:
            for k, piece in enumerate(np.split(counts, 32)):
                yield pa.RecordBatch.from_pylist([{"part": k, "counts": piece.tobytes()}], schema=schema)
    return rows.mapInArrow(run, "doc_id bigint, n bigint, point bigint, check bigint, part int, counts binary")


def shingle_levels(counted: DataFrame, join: Join) -> np.ndarray:
    """For each counter by how much it exceeds the mean: of a fixed size for any corpus.

    Shingles of one document raise a counter by chance, by some square roots of the mean; beyond that a level is a
    quarter of a power of two, so that those in few documents come before those that a group of near copies shares.
    """
    width = (1 << join.counter_bits) // 32

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                now = np.frombuffer(data, np.int32).astype(np.int64)
                total[part] = total[part] + now if part in total else now
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    rows = counted.filter("part is not null").select("part", "counts").repartition(32, "part").mapInArrow(add, "part int, counts binary").collect()
    counts = np.zeros(1 << join.counter_bits, np.int64)
    for r in rows:
        counts[r.part * width:(r.part + 1) * width] += np.frombuffer(r.counts, np.int64)
    mean = max(1.0, counts.mean())
    excess = np.maximum(counts - mean, 0) / np.sqrt(mean)
    return np.clip(np.floor(4 * np.log2(1 + excess)), 0, 255).astype(np.uint8)


def first_regions(rows: DataFrame, levels, join: Join) -> DataFrame:
    """(cell, point, n, most): every set with the shingles of whose regions it is a member, its size, and the most shingles
    that a set may have whose first common shingle with it this is, if they are linked."""
    schema = pa.schema([("cell", pa.int64()), ("point", pa.int64()), ("n", pa.int32()), ("most", pa.int32())])

    def run(batches):
        level, seen = levels.value, set()
        for batch in batches:
            for part in slices(batch, "text", join.slice_bytes):
                cells, points, sizes, keeps, most = [], [], [], [], []
                for _, s in shingle_sets(part, join):
                    point = set_id(s)[0]
                    if point in seen:  # a copy met in this task
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(point)
                    lv = level[(s >> np.uint64(64 - join.counter_bits)).astype(np.int64)]
                    n = len(s)
                    keep = n - (join.percent * n + 99) // 100 + 1
                    cells.append(s[np.argsort(lv, kind="stable")[:keep]])
                    points.append(point)
                    sizes.append(n)
                    keeps.append(keep)
                    # those before it are not common, so at most n less its place are
                    most.append((n - np.arange(keep)) * (100 + join.percent) // join.percent - n)
                if cells:
                    each = (np.repeat(np.array(x), keeps) for x in (np.array(points, np.int64), np.array(sizes, np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), *map(pa.array, each), pa.array(np.concatenate(most).astype(np.int32))], schema=schema)
    return rows.mapInArrow(run, "cell bigint, point bigint, n int, most int")


def region_members(cells: DataFrame) -> DataFrame:
    """(pivot, point) for all members but the pivot itself of regions with two or more.

    Rows of a shingle follow each other by size. Where the next is larger than any set before it may be linked with,
    another region begins, so sets of sizes that can't be linked don't meet. A region's first is its pivot, and only
    that and the largest size are held while the others pass.
    """
    ordered = (cells.withColumn("order", F.xxhash64("point")).repartition("cell")
               .sortWithinPartitions("cell", "n", "order", "point"))
    schema = pa.schema([("pivot", pa.int64()), ("point", pa.int64())])

    def run(batches):
        cell = pivot = reach = None
        seen: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = []
            for c, p, n, most in zip(*(batch.column(x).to_pylist() for x in ("cell", "point", "n", "most"))):
                if c != cell or n > reach:
                    cell, pivot, reach = c, p, most
                    continue
                reach = max(reach, most)
                if p != pivot and (pivot, p) not in seen:
                    fresh.append((pivot, p))
                    if len(seen) < 1_000_000:
                        seen.add((pivot, p))
            if fresh:
                a, b = zip(*fresh)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
    return ordered.mapInArrow(run, "pivot bigint, point bigint").distinct()


def _filter_of(points: DataFrame, join: Join) -> np.ndarray:
    """A bitmap of a fixed size that holds all points: tells early which sets nobody asks for."""
    size = 1 << join.filter_bits

    def run(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[mix64(np.asarray(b.column("point")).view(np.uint64)) >> np.uint64(64 - join.filter_bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])
    out = np.zeros(size // 8, np.uint8)
    for r in points.select("point").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def sets_of(rows: DataFrame, points: DataFrame, join: Join) -> DataFrame:
    """(point, shingles): the sets that are asked for, each once."""
    wanted = rows.sparkSession.sparkContext.broadcast(_filter_of(points, join))

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            for part in slices(batch, "text", join.slice_bytes):
                ids, sets = [], []
                for _, s in shingle_sets(part, join):
                    point = set_id(s)[0]
                    place = int(mix64(np.array([point], np.int64).view(np.uint64))[0] >> np.uint64(64 - join.filter_bits))
                    if point in seen or not bits[place >> 3] >> (7 - (place & 7)) & 1:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(point)
                    ids.append(point)
                    sets.append(s.tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["point", "shingles"])
    found = rows.mapInArrow(run, "point bigint, shingles binary")
    return found.join(points, "point", "left_semi").groupBy("point").agg(F.any_value("shingles").alias("shingles"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def sketch(s: np.ndarray, join: Join) -> tuple[int, bytes]:
    """How many counts, and the counts: shingles in each part of the hash's range, in a byte each if that is enough."""
    low, high = join.sketch_bits
    bits = min(max(low, len(s).bit_length()), high)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return 1 << bits, counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def read_sketch(data: bytes, width: int, to: int) -> np.ndarray:
    """The counts of a sketch of ``width``, made as coarse as ``to``."""
    counts = np.frombuffer(data, np.uint8 if len(data) == width else np.uint32)
    return counts if to == width else counts.reshape(to, -1).sum(1)


def sketches_of(sets: DataFrame, join: Join) -> DataFrame:
    """(point, width, shingles): the sketch of each set."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                width, data = zip(*(sketch(np.frombuffer(d, np.uint64), join) for d in batch.column("shingles").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array(width, pa.int32()), pa.array(data, pa.binary())], ["point", "width", "shingles"])
    return sets.select("point", "shingles").mapInArrow(run, "point bigint, width int, shingles binary")


def distances(members: DataFrame, sets: DataFrame, join: Join, sketched: bool = False) -> DataFrame:
    """(region, pivot, point, inside, union): common and all shingles of each member and its region's pivot.

    ``members``: (region, pivot, point); of sketches, at least as many common ones. Members stream past the pivot's set; a pivot's members are split over
    tasks by hash, each with a copy of the set.
    """
    # all of a pivot's members are measured alike, so that their distances to it compare
    coarse = F.min("width") if sketched else F.lit(0)
    widths = members.join(sets.select("point", "width"), "point") if sketched else members
    many = widths.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / join.members).cast("int").alias("shares"), coarse.alias("least"))
    pairs = members.select("pivot", "point").distinct()
    who = (pairs.join(many, "pivot").withColumn("share", F.pmod(F.xxhash64("point"), F.col("shares")).cast("int"))
           .select("pivot", "share", "point", F.lit(1).alias("is_member"), "least")
           .unionByName(many.select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("pivot").alias("point"), F.lit(0).alias("is_member"), "least")))
    rows = (who.join(sets, "point").repartition("pivot", "share").sortWithinPartitions("pivot", "share", "is_member"))

    def run(batches):
        now, held, to = None, None, 0
        for batch in batches:
            out = []
            width = batch.column("width").to_pylist() if sketched else [0] * batch.num_rows
            for pivot, share, is_member, point, data, least, own in zip(*(batch.column(c).to_pylist() for c in ("pivot", "share", "is_member", "point", "shingles", "least")), width):
                if not is_member:
                    to = min(least, own)
                s = read_sketch(data, own, to) if sketched else np.frombuffer(data, np.uint64)
                if not is_member:
                    now, held = (pivot, share), s
                    continue
                if now != (pivot, share):
                    raise ValueError("a region without its pivot")
                if sketched:
                    both, all_ = int(np.minimum(held, s).sum()), int(held.sum()) + int(s.sum())
                else:
                    both, all_ = common(held, s), len(held) + len(s)
                out.append((pivot, point, both, all_ - both))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["pivot", "point", "inside", "union"])
    measured = rows.mapInArrow(run, "pivot bigint, point bigint, inside bigint, union bigint")
    return members.join(measured, ["pivot", "point"])


def near_pairs(width: np.ndarray, data: list[bytes], component: np.ndarray, join: Join) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): members of other components that by their sketches may be linked to member i, every pair once.

    ``component`` may change between two results.
    """
    for to in np.unique(width):
        # a set of more than twice the counts is too large for a link; one of fewer has had its turn
        who = np.flatnonzero((width == to) | (width == 2 * to))
        who = who[np.argsort(width[who], kind="stable")]
        counts = np.array([read_sketch(data[i], width[i], to) for i in who])
        n = counts.sum(1, dtype=np.int64)
        for i in range(min(int((width == to).sum()), len(who) - 1)):
            rest = np.arange(i + 1, len(who))
            fits = (component[who[rest]] != component[who[i]]) & (100 * np.minimum(n[i], n[rest]) >= join.percent * np.maximum(n[i], n[rest]))
            rest = rest[fits]
            both = np.minimum(counts[i], counts[rest]).sum(1, dtype=np.int64)
            near = who[rest[100 * both >= join.percent * (n[i] + n[rest] - both)]]
            if len(near):
                yield who[i], near


def worth_comparing(groups: DataFrame, sketches: DataFrame, join: Join) -> DataFrame:
    """The rows of ``groups`` (group, point, component) that by their sketches may be linked to one of another component there."""
    names = ["group", "point", "component"]
    rows = groups.select(names).join(sketches, "point").repartition("group").sortWithinPartitions("group", "point")

    def kept(now, members):
        keep = np.zeros(len(members), bool)
        for i, others in near_pairs(np.array([m[2] for m in members]), [m[3] for m in members], np.array([m[1] for m in members]), join):
            keep[i] = True
            keep[others] = True
        return [(now, *members[i][:2]) for i in np.flatnonzero(keep)]

    def run(batches):
        now, members = None, []
        for batch in batches:
            out = []
            for g, *member in zip(*(batch.column(x).to_pylist() for x in (*names, "width", "shingles"))):
                if g != now:
                    out += kept(now, members)
                    now, members = g, []
                members.append(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        if out := kept(now, members):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    return rows.mapInArrow(run, "group bigint, point bigint, component bigint")


def compare_leaves(groups: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """(a, b): links between members of different components, for groups (group, point, component) of bounded size."""
    rows = groups.join(sets, "point").repartition("group").sortWithinPartitions("group", "point")

    def links(members):
        width, data = zip(*(sketch(m[2], join) for m in members)) if members else ((), ())
        component = np.array([m[1] for m in members])
        for i, others in near_pairs(np.array(width), data, component, join):
            for j in others:
                (a, _, sa), (b, _, sb) = members[i], members[j]
                if component[i] != component[j]:
                    both = common(sa, sb)
                    if 100 * both >= join.percent * (len(sa) + len(sb) - both):
                        component[component == component[j]] = component[i]  # they need not be compared any more
                        yield a, b

    def run(batches):
        now, members = None, []
        for batch in batches:
            out = []
            for g, point, c, data in zip(*(batch.column(x).to_pylist() for x in ("group", "point", "component", "shingles"))):
                if g != now:
                    out += links(members)
                    now, members = g, []
                members.append((point, c, np.frombuffer(data, np.uint64)))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if found := list(links(members)):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return rows.mapInArrow(run, "a bigint, b bigint")


def _linked(measured: DataFrame, join: Join) -> DataFrame:
    return measured.filter(100 * F.col("inside") >= join.percent * F.col("union")).select(F.col("pivot").alias("a"), F.col("point").alias("b"))


def _open_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (group, point, width, was) whose members are in more than one component, with component, size and counts, written."""
    found = write_out(components(links), "components")
    named = groups.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    size = named.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("width").alias("counts"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    out = write_out(named.join(size.select("group", "size", "counts"), "group"), "open")
    discard(found)
    return out


def linked_points(rows: DataFrame, counted: DataFrame, join: Join) -> DataFrame:
    """(a, b): links between points that connect all points that are linked, written.

    Every table is deleted after its last reader, so the folder holds the sets, their sketches, the links and one round.
    """
    spark = rows.sparkSession
    levels = spark.sparkContext.broadcast(shingle_levels(counted, join))
    members = write_out(region_members(first_regions(rows, levels, join)).withColumn("region", F.col("pivot")), "regions")
    points = write_out(members.select("point").unionByName(members.select(F.col("pivot").alias("point"))).distinct(), "points")
    sets = write_out(sets_of(rows, points, join), "sets")
    discard(points)
    sketches = write_out(sketches_of(sets, join), "sketches")
    links = None

    def add(now: DataFrame) -> DataFrame:
        out = write_out(now if links is None else links.unionByName(now), "links")
        if links is not None:
            discard(links)
        return out

    for level in range(join.max_rounds + 1):
        measured = write_out(distances(members, sketches, join, sketched=True), "distances")
        discard(members)
        # region is the pivot, as a pair is measured once whatever regions it is in
        near = _linked(measured, join).select(F.col("a").alias("region"), F.col("a").alias("pivot"), F.col("b").alias("point")).distinct()
        links = add(_linked(distances(near, sets, join), join))
        # rings as wide as the distance, two neighbours each; the pivot is done
        ring = F.floor((1 - F.col("inside") / F.col("union")) / (1 - join.percent / 100.0) - 1e-9).cast("int")
        ringed = measured.withColumn("ring", F.greatest(ring, F.lit(0)))
        last = ringed.groupBy("region").agg(F.greatest(F.max("ring"), F.lit(1)).alias("last"), F.count(F.lit(1)).alias("was"))
        # the first ring is whole in the group of the first two, and the last in that of the last two
        own = F.array_distinct(F.array(F.greatest("ring", F.lit(1)), F.least(F.col("ring") + 1, "last")))
        rings = ringed.join(last, "region").select("region", "point", "was", F.explode(own).alias("ring"))
        groups = rings.select(F.xxhash64("region", "ring", F.lit(level)).alias("group"), "point", "was").distinct()
        open_ = _open_groups(groups.join(sketches.select("point", "width"), "point"), links)
        discard(measured)
        if open_.isEmpty():
            discard(open_)
            break
        small = (F.col("size") <= join.leaf) & (F.col("counts") <= join.leaf_counts)
        # the regions of the first round are of single shingles, whose pivot is not chosen to part them
        whole = F.lit(level == join.max_rounds) | (F.lit(level > 0) & (4 * F.col("size") > 3 * F.col("was")))
        # what pivots can't part: every block of members against every other
        blocks = F.ceil(F.greatest(F.col("size") / join.leaf, F.col("counts") / join.leaf_counts) * 2).cast("int")
        cut = open_.filter(~small & whole).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("point", F.lit("block")), F.col("blocks")).cast("int"))
        both = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        both = both.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "point", "component")
        direct = open_.filter(small).select("group", "point", "component").unionByName(both)
        links = add(compare_leaves(worth_comparing(direct, sketches, join), sets, join))
        large = open_.filter(~small & ~whole).select("group", "point")
        lead = large.groupBy("group").agg(F.min_by("point", F.xxhash64("point", F.lit(level))).alias("pivot"))
        members = write_out(large.join(lead, "group").filter("point <> pivot").select(F.col("group").alias("region"), "pivot", "point"), "regions")
        discard(open_)
        if members.isEmpty():
            break
    discard(sets)
    discard(sketches)
    return links


def jaccard_components(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    rows = text_rows(docs, id_col, text_col)
    counted = write_out(with_sets(rows, join), "set-ids")
    ids = counted.filter("part is null").select("doc_id", "n", "point", "check")
    first = ids.filter("n > 0").groupBy("point").agg(F.min("doc_id").alias("first_id"))
    links = linked_points(rows, counted, join)
    found = write_out(components(links), "components")
    discard(links)
    # a component's id is the smallest document of all its points
    group = first.join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = group.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = group.join(least, "component").select("point", "component_id")
    alone = ids.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return ids.filter("n > 0").join(named, "point").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def first_of_groups(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with its own columns: the smallest by (id, place in the input), null ids last.

    Rows count by themselves, whatever ids they share. Rows without a word are linked with nothing and all stay, but
    repeats of one with an id stay one.
    """
    # the key is written with the rows, so that it stays theirs when a task runs again
    rows = write_out(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = write_out(jaccard_components(rows, join, "_row", text_col), "components")
    named = rows.select("_row", F.col(id_col).alias("_id")).join(found.filter("n_shingles > 0").withColumnRenamed("doc_id", "_row"), "_row")
    rank = F.struct(F.col("_id").isNull(), "_id", "_row")
    linked = named.groupBy("component_id").agg(F.min_by("_row", rank).alias("_row"))
    # rows without a word are told where they lie, as texts cross the network once, in the end
    text = F.col(text_col).cast("string")
    empty = rows.filter(F.coalesce(F.btrim(text, F.lit(WORD_SPACE.decode())), F.lit("")) == "").select("_row", F.col(id_col).alias("_id"), text.alias("_text"))
    alone = empty.filter("_id is not null").groupBy("_id", "_text").agg(F.min("_row").alias("_row"))
    keep = linked.select("_row").unionByName(alone.select("_row")).unionByName(empty.filter("_id is null").select("_row"))
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)
