"""Language-model scoring with Brown class-based bigrams.

P(word | word before) = share * P(class | class before) * P(word | class) + (1 - share) * P(word), the last by add-one.
Words seen in training at least ``min_count`` times are put into classes by exchange: in each round a word moves to
the class that raises the likelihood of the class bigrams most, given the classes of its neighbours. Half of the
words move at a time, as all neighbours of a word moving with it would undo its gain; the classes with the highest
likelihood of all rounds are used. Rarer and unknown words share one class, add-one within it.

Texts are tokenised once, into blocks of codes with a dictionary each. A round joins the dictionaries to the table
of words and classes, a row per word and block, and counts class bigrams and each word's neighbouring classes in the
block. The table of words grows with the corpus and stays a table; only the classes' transition counts, a square of
the number of classes, are sent around. Words are told apart by a 64-bit hash.

Results for odd input: a null or empty text is one end token; a null id counts as the empty text, so it is in
training; repeated rows give a row each and count each; without training text every token has probability 1 in the
base and in the model; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import discard, prefix_hash, run_starts, span_hash, text_buffer, text_rows, words_in, write_out
from quantloom.llm.postings import blocks, cut

#: The end token's key; also stands before the first word.
END = np.int64(-0x61C8864680B583EB)


@dataclass(frozen=True)
class Brown:
    #: with the class of rare words
    classes: int = 64
    min_count: int = 5
    rounds: int = 4
    share: float = 0.95
    #: added to each class transition
    add: float = 0.5
    #: documents whose crc32(id) mod ``folds`` is ``held`` are not learnt from
    folds: int = 7
    held: int = 2
    block_bytes: int = 8 << 20

    @property
    def rare(self) -> int:
        return self.classes - 1


_CODED = "block bigint, key bigint, code int, n_train bigint, doc_id bigint, held_out boolean, width int, codes binary"


def coded_blocks(rows: DataFrame, brown: Brown) -> DataFrame:
    """Dictionary rows (block, key, code, n_train) and document rows (block, doc_id, held_out, width, codes)."""
    names = [c.split()[0] for c in _CODED.split(", ")]

    def table(n, **have):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([have.get(c, pa.nulls(n, t)) for c, t in zip(names, kinds)], names=names)

    def run(batches):
        task = TaskContext.get().partitionId()
        for seq, part in enumerate(blocks(batches, brown.block_bytes)):
            ids = part.column("doc_id").chunk(0)
            held = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % brown.folds == brown.held for x in ids.to_pylist()])
            buf, off = text_buffer(part.column("text").chunk(0))
            starts, ends, row = words_in(buf, off)
            lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
            h = span_hash(prefix_hash(lower), starts, ends).view(np.int64)
            # an end before the first word and after the last
            n = part.num_rows
            size = np.bincount(row, minlength=n) + 2
            begin = np.concatenate(([0], np.cumsum(size)))
            flow = np.full(begin[-1], END)
            flow[np.arange(len(h)) + 2 * row + 1] = h
            key, code = np.unique(flow, return_inverse=True)
            code = code.astype(np.int32)
            counted = np.repeat(~held, size)
            counted[begin[:-1]] = False
            learnt = np.bincount(code[counted], minlength=len(key))
            block = pa.array(np.full(max(n, len(key)), (task << 24) + seq))
            yield from table(len(key), block=block[:len(key)], key=pa.array(key), code=pa.array(np.arange(len(key), dtype=np.int32)),
                             n_train=pa.array(learnt)).to_batches(max_chunksize=20_000)
            yield from table(n, block=block[:n], doc_id=ids, held_out=pa.array(held), width=pa.array(np.full(n, len(key), np.int32)),
                             codes=cut(code, begin[:-1])).to_batches(max_chunksize=512)
    return rows.mapInArrow(run, _CODED)


def _by_block(places: DataFrame, words: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Per block its words (block, key, code) with ``columns`` of the table of words, then its documents."""
    known = places.join(words.select("key", *columns), "key")
    rows = known.withColumn("kind", F.lit(0)).unionByName(docs.select("block", "doc_id", "held_out", "width", "codes").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "kind")


def _each_block(batches, columns: list[str]):
    """(known words as arrays: code, key, *columns; document rows) of each block, one block held at a time."""
    now, words, docs = None, [], []

    def done():
        if docs:
            empty = [np.zeros(0, np.int64)] * (2 + len(columns))
            yield ([np.concatenate(x) for x in zip(*words)] if words else empty), pa.Table.from_batches(docs).combine_chunks()

    for batch in batches:
        block = np.asarray(batch.column("block"))
        at = run_starts(block)
        for a, b in zip(at, np.append(at[1:], len(block))):
            if block[a] != now:
                yield from done()
                now, words, docs = block[a], [], []
            part = batch.slice(a, b - a)
            kind = np.asarray(part.column("kind"))
            k = int((kind == 0).sum())  # words come first
            if k:
                words.append([np.asarray(part.column(c).slice(0, k)) for c in ("code", "key", *columns)])
            if k < len(kind):
                docs.append(part.slice(k).select(["doc_id", "held_out", "width", "codes"]))
    yield from done()


def _flow(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All codes of the documents one after the other, and where each begins."""
    data, off = text_buffer(docs.column("codes").chunk(0))
    return data.view(np.int32), off // 4


def _spread(codes: np.ndarray, values: np.ndarray, width: int, default) -> np.ndarray:
    out = np.full(width, default, values.dtype if len(values) else np.int64)
    out[codes] = values
    return out


def count_neighbours(places: DataFrame, coded: DataFrame, words: DataFrame, brown: Brown, only_matrix: bool = False) -> DataFrame:
    """Rows (key, cls, slots, counts) of ``words``, the frequent ones: how often each class follows (slot: class) and precedes
    (slot: classes + class); rows with a null key hold a task's class bigrams (slot: class * classes + next)."""
    k = brown.classes
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        matrix = np.zeros(k * k, np.int64)
        for (code, key, cls), docs in _each_block(batches, ["cls"]):
            width = docs.column("width")[0].as_py()
            group = _spread(code, cls.astype(np.int64), width, brown.rare)
            flow, off = _flow(docs)
            inner = np.ones(len(flow), bool)
            inner[off[:-1]] = False  # a document's first token follows nothing
            b = flow[inner].astype(np.int64)
            a = flow[np.flatnonzero(inner) - 1].astype(np.int64)
            matrix += np.bincount(group[a] * k + group[b], minlength=k * k)
            if only_matrix:
                continue
            free = _spread(code, np.ones(len(code), bool), width, False).astype(bool)
            fa, fb = free[a], free[b]
            pair = np.concatenate((a[fa] * (2 * k) + group[b[fa]], b[fb] * (2 * k) + k + group[a[fb]]))
            if not len(pair):
                continue
            pair.sort()
            at = run_starts(pair)
            n = np.diff(np.append(at, len(pair))).astype(np.uint32)
            pair = pair[at]
            word, slot = pair // (2 * k), (pair % (2 * k)).astype(np.uint16)
            at = run_starts(word)
            keys = _spread(code, key, width, 0)
            yield from pa.Table.from_arrays([pa.array(keys[word[at]]), pa.array(group[word[at]].astype(np.int32)), cut(slot, at), cut(n, at)],
                                            schema=schema).to_batches(max_chunksize=20_000)
        slots = np.flatnonzero(matrix)
        if len(slots):
            yield pa.RecordBatch.from_pylist([{"slots": slots.astype(np.uint32).tobytes(), "counts": matrix[slots].tobytes()}], schema=schema)
    docs = coded.filter("codes is not null and not held_out")
    return _by_block(places, words, docs, ["cls"]).mapInArrow(run, "key bigint, cls int, slots binary, counts binary")


def class_matrix(counted: DataFrame, brown: Brown) -> np.ndarray:
    """The class bigrams of all tasks: as many numbers as classes squared."""
    def run(batches):
        for batch in batches:
            for s, n in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, np.uint32).astype(np.int64)), pa.array(np.frombuffer(n, np.int64))], ["slot", "n"])
    out = np.zeros(brown.classes ** 2)
    for r in counted.filter("key is null").select("slots", "counts").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out.reshape(brown.classes, brown.classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the classes contribute to the log likelihood of the training text."""
    return float(_f(matrix).sum() - _f(matrix.sum(0)).sum() - _f(matrix.sum(1)).sum())


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class, of all but the last, that suits each word best.

    ``n`` times class ``slot`` follows ``word`` (before ``classes``) or precedes it (from there on), sorted by word;
    ``own`` is each word's class. Classes that a word never meets add nothing to its gain.
    """
    k = len(matrix)
    gain = np.zeros((len(own), k))
    for side, m in ((slot < k, matrix), (slot >= k, np.ascontiguousarray(matrix.T))):
        w, c, x = word[side], slot[side] % k, n[side].astype(float)
        if not len(w):
            continue
        at = run_starts(w)
        who = w[at]
        col, fcol = np.ascontiguousarray(m.T), _f(m.T)  # a row per neighbouring class
        part = _f(col[c] + x[:, None]) - fcol[c]
        # the word's own class is taken without the word
        mine = col[c, own[w]]
        part[np.arange(len(w)), own[w]] = _f(mine) - _f(np.maximum(mine - x, 0))
        total, all_n = m.sum(1), np.add.reduceat(x, at)
        less = _f(total[None, :] + all_n[:, None]) - _f(total)[None, :]
        less[np.arange(len(who)), own[who]] = _f(total[own[who]]) - _f(np.maximum(total[own[who]] - all_n, 0))
        gain[who] += np.add.reduceat(part, at, axis=0) - less
    gain[:, -1] = -np.inf
    # of classes that suit alike, the one the word is in, else the first
    gain[np.arange(len(own)), own] += 1e-9
    return gain.argmax(1).astype(np.int32)


def moved(counted: DataFrame, matrix: np.ndarray, brown: Brown, chunk: int = 2048) -> DataFrame:
    """(key, new_cls) for every frequent word, from its neighbours in all blocks."""
    k = brown.classes
    rows = counted.filter("key is not null").repartition("key").sortWithinPartitions("key")

    def choose(keys, own, held):
        word, slots, counts = (np.concatenate(x) for x in zip(*held))
        dense = np.bincount(word * (2 * k) + slots, weights=counts, minlength=len(keys) * 2 * k)
        some = np.flatnonzero(dense)
        out = best_classes(some // (2 * k), some % (2 * k), dense[some], np.array(own), matrix)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out)], ["key", "new_cls"])

    def run(batches):
        keys, own, held = [], [], []
        for batch in batches:
            slots, off = text_buffer(batch.column("slots"))
            counts = text_buffer(batch.column("counts"))[0].view(np.uint32)
            slots, off = slots.view(np.uint16).astype(np.int64), off // 2
            key = np.asarray(batch.column("key"))
            cls = np.asarray(batch.column("cls"))
            at = run_starts(key)
            for a, b in zip(at, np.append(at[1:], len(key))):
                if not keys or keys[-1] != key[a]:
                    if len(keys) == chunk:
                        yield choose(keys, own, held)
                        keys, own, held = [], [], []
                    keys.append(key[a])
                    own.append(cls[a])
                lo, hi = off[a], off[b]
                held.append((np.full(hi - lo, len(keys) - 1), slots[lo:hi], counts[lo:hi]))
        if keys:
            yield choose(keys, own, held)
    return rows.mapInArrow(run, "key bigint, new_cls int")


def cluster(coded: DataFrame, brown: Brown = Brown()) -> tuple[DataFrame, np.ndarray, list[float]]:
    """The table of words (key, c, cls), the class bigrams, and the likelihood after each round."""
    every = coded.filter("key is not null")
    counts = write_out(every.groupBy("key").agg(F.sum("n_train").alias("c")).filter("c > 0"), "counts")
    first = F.pmod(F.xxhash64("key"), F.lit(brown.classes - 1)).cast("int")
    words = write_out(counts.filter(F.col("c") >= brown.min_count).select("key", first.alias("cls")), "words")
    # the only words that rounds look at; all others are in the class of rare words
    places = write_out(every.select("block", "key", "code").join(words.select("key"), "key"), "places")
    best, history = None, []
    for turn in range(brown.rounds + 1):
        counted = write_out(count_neighbours(places, coded, words, brown, only_matrix=turn == brown.rounds), "neighbours")
        matrix = class_matrix(counted, brown)
        history.append(likelihood(matrix))
        if best is None or history[-1] > best[0]:
            if best is not None:
                discard(best[1])
            best = history[-1], words, matrix
        if turn < brown.rounds:
            new = moved(counted, matrix, brown)
            turns = F.lit(True) if turn == 0 else F.pmod(F.xxhash64("key", F.lit("half")) + turn, F.lit(2)) == 0
            now = words
            words = write_out(now.join(new, "key", "left").select("key", F.when(turns, F.coalesce("new_cls", "cls")).otherwise(F.col("cls")).alias("cls")), "words")
            if now is not best[1]:
                discard(now)
        discard(counted)
    discard(places)
    return write_out(counts.join(best[1], "key", "left").select("key", "c", F.coalesce("cls", F.lit(brown.rare)).alias("cls")), "words"), best[2], history


def brown_scores(docs: DataFrame, brown: Brown = Brown(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    coded = write_out(coded_blocks(text_rows(docs, id_col, text_col), brown), "coded")
    words, matrix, _ = cluster(coded, brown)
    k = brown.classes
    size, kinds = np.zeros(k), np.zeros(k)
    for r in words.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        size[r.cls], kinds[r.cls] = r.n, r.v
    n_all, v_all = int(size.sum()), int(kinds.sum())
    change = (matrix + brown.add) / (matrix.sum(1, keepdims=True) + brown.add * k) if n_all else np.ones((k, k))
    below = np.maximum(size, 1)
    below[brown.rare] = size[brown.rare] + kinds[brown.rare] + 1

    def run(batches):
        for (code, _, c, cls), found in _each_block(batches, ["c", "cls"]):
            width = found.column("width")[0].as_py()
            count = _spread(code, c.astype(np.int64), width, 0)
            group = _spread(code, cls.astype(np.int64), width, brown.rare)
            alone = (count + 1) / (n_all + v_all + 1)
            within = (count + (group == brown.rare)) / below[group]
            flow, off = _flow(found)
            b, a = flow, np.concatenate((flow[:1], flow[:-1]))
            p = brown.share * change[group[a], group[b]] * within[b] + (1 - brown.share) * alone[b]
            model, base, known = np.log10(p), np.log10(alone[b]), (count[b] > 0).astype(float)
            for x in (model, base, known):
                x[off[:-1]] = 0  # the end before the text is no token of it
            sums = [np.add.reduceat(x, off[:-1]) for x in (known, base, model)]
            yield from pa.Table.from_arrays([found.column("doc_id"), found.column("held_out"), pa.array(np.diff(off) - 1), pa.array(sums[0].astype(np.int64)),
                                             pa.array(np.full(len(off) - 1, n_all)), pa.array(sums[1]), pa.array(sums[2])],
                                            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_batches()
    rows = _by_block(coded.filter("key is not null").select("block", "key", "code"), words, coded.filter("codes is not null"), ["c", "cls"])
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
