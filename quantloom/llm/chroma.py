"""Chroma audio fingerprints, and alignment of recordings by them.

Samples become frames, frames the energy of the 12 pitch classes, smoothed over time and brought to unit length.
Filters compare the energy of two areas of a few frames and classes; areas are differences of an integral image.
Each of 16 filters gives two bits, so each frame gives a packed 32-bit integer.

Recordings are aligned to a set of query recordings. ``gram`` codes in a row are a key, and each place of a key in a
recording votes for each place of it in a query, at the difference of places. The offset with most votes whose share
of differing bits, where both overlap, is small enough is the alignment of the two. All queries are compared; a
recording reports the best and how many there are.

1. Recordings with equal codes are a class, and only classes are compared.
2. Keys that the same classes hold are one unit, which pairs these classes once. Pairs that cannot reach
   ``least_votes`` go, whatever the offset.
3. Votes and differing bits of each pair are counted from the codes of both.

Results for odd input: a null, empty or short recording has no codes and aligns with nothing; a null id takes no
part in alignment as a query and gives a row with a null id; repeated rows give a row each; a recording does not
align with queries of its own id; queries with equal codes count as one and report their smallest id; ties in votes
go to the smaller query, then the smaller offset, then the longer overlap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import mix64, write_out


@dataclass(frozen=True)
class Chroma:
    rate: int = 8000
    frame: int = 256
    hop: int = 64
    lowest: float = 55.0
    highest: float = 3520.0
    #: frames that a filter looks at, at most
    width: int = 8
    #: bounds between the four values of a filter, around 0
    bound: float = 0.1
    gram: int = 4
    #: keys that must agree, and bits that may differ, in an alignment
    least_votes: int = 3
    most_errors: float = 0.25

    def filters(self) -> list[tuple[int, int, int, int]]:
        """(kind, first class, classes, frames): kinds in turn, areas of every size and place."""
        return [(i % 4, (5 * i) % 9, 2 + i % 3, self.width >> (i % 3)) for i in range(16)]


#: Weights of neighbouring frames when pitch classes are smoothed.
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
#: Gray code of the four values of a filter: neighbours differ by one bit.
GRAY = np.array([0, 1, 3, 2], np.uint32)


def pitch_classes(rule: Chroma) -> np.ndarray:
    """For each frequency of a frame the pitch class it counts for."""
    f = np.fft.rfftfreq(rule.frame, 1 / rule.rate)
    out = np.zeros((len(f), 12))
    used = np.flatnonzero((f >= rule.lowest) & (f <= rule.highest))
    out[used, np.round(12 * np.log2(f[used] / 440.0)).astype(int) % 12] = 1
    return out


def chroma_frames(samples: np.ndarray, rule: Chroma, part: int = 4096) -> np.ndarray:
    """Unit vectors of 12 pitch classes, one per frame; frames without energy are zero."""
    if len(samples) < rule.frame:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, rule.frame)[::rule.hop]
    window, classes = np.hanning(rule.frame), pitch_classes(rule)
    out = [np.abs(np.fft.rfft((v - v.mean(1, keepdims=True)) * window, axis=1)) ** 2 @ classes
           for v in (view[i:i + part].astype(np.float64) for i in range(0, len(view), part))]
    c = np.concatenate(out)
    pad = np.pad(c, ((2, 2), (0, 0)))
    c = sum(w * pad[i:i + len(c)] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0.0)


def codes(samples: np.ndarray, rule: Chroma) -> np.ndarray:
    """A packed integer for each place where the widest filter fits."""
    c = chroma_frames(samples, rule)
    n = len(c) - rule.width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in rule.filters():
        whole, half, mid = area(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:  # all classes of the area against all other classes
            a, b = whole, area(0, w, 0, 12) - whole
        elif kind == 1:  # upper against lower classes
            a = area(0, w, mid, y + h)
            b = whole - a
        elif kind == 2:  # later against earlier frames
            a = area(half, w, y, y + h)
            b = whole - a
        else:  # opposite quarters against each other
            a = area(0, half, y, mid) + area(half, w, mid, y + h)
            b = whole - a
        value = np.round(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)), 9)
        out = out << np.uint32(2) | GRAY[np.searchsorted((-rule.bound, 0.0, rule.bound), value, side="right")]
    return out


def keys_of(code: np.ndarray, rule: Chroma) -> np.ndarray:
    """A 64-bit key of each ``gram`` codes in a row."""
    n = len(code) - rule.gram + 1
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(rule.gram):
        key = mix64(key * np.uint64(31) + code[j:j + max(n, 0)].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def fingerprints(recordings: DataFrame, rule: Chroma = Chroma(), id_col: str = "id", pcm_col: str = "pcm", dtype: str = "<i2") -> DataFrame:
    """(row, id, codes): packed 32-bit integers of every recording of samples of type ``dtype``."""
    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("pcm"):
                data = x.as_buffer() or b""
                step = np.dtype(dtype).itemsize
                out.append(codes(np.frombuffer(data, dtype, len(data) // step), rule).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(out, pa.binary())], ["row", "id", "codes"])
    rows = recordings.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(pcm_col).cast("binary").alias("pcm"))
    return rows.mapInArrow(run, "row bigint, id bigint, codes binary")


def class_keys(classes: DataFrame, rule: Chroma) -> DataFrame:
    """(class, asked, key, n) for each different key of each class's codes, which holds it n times."""
    names = ["class", "asked", "key", "n"]

    def run(batches):
        for batch in batches:
            for c, asked, code in zip(*(batch.column(x).to_pylist() for x in ("class", "asked", "codes"))):
                key, n = np.unique(keys_of(np.frombuffer(code, "<u4"), rule), return_counts=True)
                yield from pa.Table.from_arrays([pa.array(np.full(len(key), c)), pa.array(np.full(len(key), asked)), pa.array(key), pa.array(n)],
                                                names=names).to_batches(max_chunksize=50_000)
    return classes.select("class", "asked", "codes").mapInArrow(run, "class bigint, asked boolean, key bigint, n bigint")


def vote_counts(a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many equal keys stand at each offset, from -(len(b) - 1) on.

    Keys with very many places in both are counted by a convolution, others place by place, ``most`` at a time.
    """
    size = len(a) + len(b) - 1
    both = np.intersect1d(a, b)
    if not len(both):
        return np.zeros(max(size, 0), np.int64)
    out = np.zeros(size, np.int64)
    places = []
    for x in (a, b):
        at = np.flatnonzero(np.isin(x, both))
        key = np.searchsorted(both, x[at])
        order = np.argsort(key, kind="stable")
        places.append((at[order], np.bincount(key, minlength=len(both))))
    (pa_, na), (pb, nb) = places
    ea, eb = np.cumsum(na) - na, np.cumsum(nb) - nb
    heavy = na * nb > 64 * size
    for k in np.flatnonzero(heavy):
        n = 1 << size.bit_length()
        x, y = np.zeros(n), np.zeros(n)
        x[pa_[ea[k]:ea[k] + na[k]]] = 1
        y[len(b) - 1 - pb[eb[k]:eb[k] + nb[k]]] = 1
        out += np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), n)[:size]).astype(np.int64)
    light = np.flatnonzero(~heavy)
    # one row per place in a of a light key, with all places in b
    key = np.repeat(light, na[light])
    mine = pa_[np.repeat(ea[light], na[light]) + np.arange(len(key)) - np.repeat(np.cumsum(na[light]) - na[light], na[light])]
    done = np.cumsum(nb[key])
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, side="right")))
        n = nb[key[at:stop]]
        other = pb[np.repeat(eb[key[at:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out += np.bincount(np.repeat(mine[at:stop], n) - other + len(b) - 1, minlength=size)
        at = stop
    return out


def best_offset(a: np.ndarray, b: np.ndarray, rule: Chroma) -> tuple[int, int, int, float] | None:
    """(offset, votes, overlap, bit_errors) of two code sequences: of the offsets that pass, that with most votes."""
    ka, kb = keys_of(a, rule), keys_of(b, rule)
    votes = vote_counts(ka, kb)
    able = np.flatnonzero(votes >= rule.least_votes)
    for i in able[np.argsort(-votes[able], kind="stable")]:
        offset = int(i) - (len(kb) - 1)
        x, y = a[max(offset, 0):], b[max(-offset, 0):]
        n = min(len(x), len(y))
        wrong = int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32.0 * n)
        if wrong <= rule.most_errors:
            return offset, int(votes[i]), n, wrong
    return None


def compare(pairs: DataFrame, rule: Chroma) -> DataFrame:
    """(class, query, q1, q2, offset, votes, overlap, bit_errors) of the pairs (class, query, q1, q2, codes, own) that align."""
    names = ["class", "query", "q1", "q2", "offset", "votes", "overlap", "bit_errors"]

    def run(batches):
        for batch in batches:
            out = []
            for *pair, mine, own in zip(*(batch.column(x).to_pylist() for x in (*names[:4], "codes", "own"))):
                found = best_offset(np.frombuffer(mine, "<u4"), np.frombuffer(own, "<u4"), rule)
                if found:
                    out.append((*pair, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if n == "bit_errors" else pa.int64()) for n, x in zip(names, zip(*out))], names)
    return pairs.select(*names[:4], "codes", "own").mapInArrow(run, "class bigint, query bigint, q1 bigint, q2 bigint, offset bigint, votes bigint, overlap bigint, bit_errors double")


def code_classes(prints: DataFrame, is_query: Column) -> DataFrame:
    """(row, id, class, class_id, q1, q2) for every recording.

    ``class``: the first row with equal codes; ``class_id``: the smallest id of these; q1 and q2: the smallest ids
    of the queries among them, null if there are none.
    """
    one = prints.select("row", "id", F.sha2("codes", 256).alias("sum"), F.when(is_query, F.col("id")).alias("q"))
    first = one.groupBy("sum").agg(F.min("row").alias("class"), F.min("id").alias("class_id"), F.min("q").alias("q1"))
    asked = one.filter("q is not null").join(first.select("sum", "q1"), "sum").filter("q > q1").groupBy("sum").agg(F.min("q").alias("q2"))
    return one.join(first.join(asked, "sum", "left"), "sum").select("row", "id", "class", "class_id", "q1", "q2")


def candidates(classes: DataFrame, rule: Chroma) -> DataFrame:
    """(class, query) of the classes (class, asked, codes) that may have ``least_votes`` at one offset."""
    found = write_out(class_keys(classes, rule), "chroma-keys")
    held = write_out(found.join(found.filter("asked").select("key").distinct(), "key", "left_semi"), "chroma-held")
    same = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(class))").alias("x"), F.expr("bit_xor(xxhash64(class, 1))").alias("y"),
                                   F.max("n").alias("most")).filter("n > 1")
    # a place in a recording meets one place in a query at an offset
    units = same.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.sum("most").alias("bound")).select("key", "bound")
    holds = write_out(held.join(units, "key").select("key", "class", "asked", "bound"), "chroma-units")
    return (holds.select("key", "class", "bound").join(holds.filter("asked").select("key", F.col("class").alias("query")), "key").filter("class <> query")
            .groupBy("class", "query").agg(F.sum("bound").alias("bound")).filter(F.col("bound") >= rule.least_votes).select("class", "query"))


def aligned_classes(prints: DataFrame, members: DataFrame, rule: Chroma = Chroma()) -> DataFrame:
    """(class, query, q1, q2, offset, votes, overlap, bit_errors): every class against every class of queries that it fits.

    ``members``: the recordings of code_classes(). ``offset``: the place in the recording less the place in the
    query, in codes. A class of queries with several recordings fits itself.
    """
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("q1").alias("q1"), F.max("q2").alias("q2")).withColumn("asked", F.expr("q1 is not null"))
    classes = write_out(prints.select(F.col("row").alias("class"), "codes").join(sizes, "class"), "code-classes")
    itself = classes.filter("asked and n > 1").select("class", F.col("class").alias("query"))
    pairs = write_out(candidates(classes, rule).unionByName(itself), "candidates")
    codes_ = classes.select("class", "codes")
    own = classes.filter("asked").select(F.col("class").alias("query"), "q1", "q2", F.col("codes").alias("own"))
    return write_out(compare(pairs.join(codes_, "class").join(own, "query"), rule), "aligned")


def align(prints: DataFrame, is_query: Column, rule: Chroma = Chroma()) -> DataFrame:
    """(row, class_id, query_id, offset, votes, overlap, bit_errors, n_queries) of every recording.

    ``n_queries``: the classes of queries that the recording aligns with; query_id to bit_errors are those of the
    best, null without one.
    """
    members = write_out(code_classes(prints, is_query), "members")
    fits = aligned_classes(prints, members, rule)
    best = [F.max(F.struct("votes", (-F.col("q")).alias("q"), (-F.col("offset")).alias("o"), "overlap", (-F.col("bit_errors")).alias("e"))).alias("b"), F.count(F.lit(1)).alias("n_queries")]
    # copies share the result of their class, except for those with the id of a query, which is not to be found for itself
    ids = prints.filter(is_query).select("id").filter("id is not null").distinct()
    some = members.select("row", "id", "class").join(ids, "id", "left_semi")
    of_class = fits.withColumn("q", F.col("q1")).groupBy("class").agg(*best)
    of_row = (some.join(fits, "class").withColumn("q", F.when(F.col("q1") == F.col("id"), F.col("q2")).otherwise(F.col("q1")))
              .filter("q is not null").groupBy("row").agg(*best))
    plain = members.join(ids, "id", "left_anti").select("row", "class").join(of_class, "class").drop("class")
    out = members.select("row", "class_id").join(plain.unionByName(of_row), "row", "left")
    return out.select("row", "class_id", (-F.col("b.q")).alias("query_id"), (-F.col("b.o")).alias("offset"), "b.votes", "b.overlap", (-F.col("b.e")).alias("bit_errors"),
                      F.coalesce("n_queries", F.lit(0)).cast("bigint").alias("n_queries"))


def chroma_report(recordings: DataFrame, is_query: Column, rule: Chroma = Chroma(), id_col: str = "id", pcm_col: str = "pcm", dtype: str = "<i2") -> DataFrame:
    """(id, n_codes, codes_sha256, class_id, query_id, offset, votes, overlap, bit_errors, n_queries) for every recording; no query: nulls."""
    prints = write_out(fingerprints(recordings, rule, id_col, pcm_col, dtype), "prints")
    own = prints.select("row", "id", (F.length("codes") / 4).cast("bigint").alias("n_codes"), F.sha2("codes", 256).alias("codes_sha256"))
    return own.join(align(prints, is_query, rule), "row").drop("row")
