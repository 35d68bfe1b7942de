"""Byte-level byte-pair encoding and decoding by finite-state machines.

Encoding. The merges are compiled into a transducer over bytes. In front of every prefix of a piece stands one
token that ends its encoding; a prefix's encoding is that of the prefix before its last token, and that token.
Which token it is depends only on the tokens that end here, and on whether the merges leave it beside the token
before it. A state therefore holds the few positions from which a later token may still begin, and the tokens that
lead to each. As soon as all of these begin with the same tokens, those are emitted: the lookahead is bounded. States and transitions are made when a text first needs them (lazy
determinisation) and kept up to a bound; past it the tables start anew, which changes no result.

Decoding. Ids become bytes by table, and bytes become text by an incremental UTF-8 state machine that keeps its
state between chunks: a character may be split over tokens and chunks.

Results for odd input: a null or empty text has no tokens and empty bytes; a null id gives a row with a null id;
repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import text_rows


NEVER = 1 << 60
_BYTES = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """ids = Transducer(ranks).encode(piece): as merging the pair of lowest rank until none is left."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.token = {i: t for t, i in ranks.items()}
        #: the two parts of the last merge of each token that merging makes of its own bytes
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.own = {t: i for t, i in ranks.items() if len(t) == 1}
        for t, i in ranks.items():
            if len(t) > 1 and (halves := self._halves(t)):
                self.parts[t] = halves
                self.own[t] = i
        self.prefixes = {t[:k] for t in self.own for k in range(1, len(t) + 1)}
        self.beside: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        #: A state: for each position from which a later token may begin, the bytes since and the tokens before
        #: it that aren't emitted yet, longest bytes first; and the last emitted token.
        self.states: list[tuple] = [(((b"", ()),), -1)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        #: 256 * state + byte: (256 * next state, emitted tokens)
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        parts = [token[i:i + 1] for i in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            near = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(near)
            if rank == NEVER:
                return None
            i = near.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1])

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's edge while it is merged, from the byte up to the token, and when each ends."""
        found = self.edges[side].get(token)
        if found is None:
            text, until, found = self.token[token], NEVER, []
            while True:
                found.append((text, until))
                if len(text) == 1:
                    break
                until, text = self.ranks[text], self.parts[text][side]
            found = self.edges[side][token] = found[::-1]
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Do the merges of the joined bytes leave the two tokens beside each other?

        Merges go by rank, on equal rank from the left; the two are kept apart unless at some time a merge across
        the border is due before the next merge at either edge.
        """
        if left < 0:
            return True
        found = self.beside.get((left, right))
        if found is None:
            xs, ys, i, j, get = self._edge(left, 1), self._edge(right, 0), 0, 0, self.ranks.get
            (x, next_x), (y, next_y) = xs[0], ys[0]
            while True:
                across = get(x + y, NEVER)
                if across < next_x and across <= next_y and across < NEVER:
                    found = False
                    break
                if next_x <= next_y:
                    if next_x == NEVER:
                        found = True
                        break
                    i += 1
                    x, next_x = xs[i]
                else:
                    j += 1
                    y, next_y = ys[j]
            self.beside[left, right] = found
        return found

    def step(self, state: tuple, byte: bytes) -> tuple[tuple, tuple[int, ...]]:
        entries, before = state
        ended, live, own, prefixes, beside = None, [], self.own, self.prefixes, self.beside
        for rest, chain in entries:
            word = rest + byte
            if word not in prefixes:
                continue
            if ended is None and (token := own.get(word)) is not None:
                left = chain[-1] if chain else before
                may = beside.get((left, token))
                if may if may is not None else self.may_follow(left, token):
                    ended = chain + (token,)
            live.append((word, chain))
        if ended is None:
            raise ValueError(f"no token for byte {byte!r}")
        # what all of them begin with is certain
        done = len(ended)
        for _, chain in live:
            if len(chain) < done:
                done = len(chain)
            while chain[:done] != ended[:done]:
                done -= 1
        live.append((b"", ended))
        if done:
            live = [(w, c[done:]) for w, c in live]
            before = ended[done - 1]
        # the last emitted token matters only where the next token may begin right after it
        for _, chain in live:
            if not chain:
                return (tuple(live), before), ended[:done]
        return (tuple(live), -2), ended[:done]

    def arc(self, at: int) -> tuple[int, tuple[int, ...]]:
        state, out = self.step(self.states[at >> 8], _BYTES[at & 255])
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        found = self.arcs[at] = to << 8, out
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        if len(self.beside) > 4 * self.max_states:
            self.beside.clear()
        at, ids, get = 0, [], self.arcs.get
        for byte in piece:
            at, out = get(at + byte) or self.arc(at + byte)
            if out:
                ids += out
        ids += self.states[at >> 8][0][-1][1]
        return ids


# ---- UTF-8 ---------------------------------------------------------------------------------------
# States: 0 between characters; 1-3 that many continuation bytes to come; 4-7 a first continuation byte
# from a narrower range to come (after E0, ED, F0, F4); 8 broken.
_START = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
          (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1),
         6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
BROKEN = 8


def utf8_table() -> np.ndarray:
    table = np.full((9, 256), BROKEN, np.uint8)
    for lo, hi, to in _START:
        table[0, lo:hi + 1] = to
    for state, (lo, hi, to) in _NEXT.items():
        table[state, lo:hi + 1] = to
    return table


_UTF8 = utf8_table()


class Decoder:
    """Turns ids into text chunk by chunk: ``text = d.feed(ids)`` ... ``text = d.close()``.

    Bytes that are no UTF-8 become the replacement character as bytes.decode(errors="replace") does.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        #: where each token leads from each state
        self.after = np.full((9, len(self.bytes_of)), BROKEN, np.uint8)
        for i, t in enumerate(self.bytes_of):
            state = np.arange(9, dtype=np.uint8)
            for b in t:
                state = _UTF8[state, b]
            self.after[:, i] = state
        self.state, self.rest = 0, b""

    def feed(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        state, at = self.state, 0
        # tokens that begin and end between characters need no steps
        odd = np.flatnonzero(self.after[0, ids] != 0)
        while True:
            if state == 0:
                k = np.searchsorted(odd, at)
                at = int(odd[k]) if k < len(odd) else len(ids)
            if at >= len(ids):
                break
            state = int(self.after[state, ids[at]])
            if state == BROKEN:
                break
            at += 1
        whole = self.rest + data
        if state == BROKEN:
            return self._mend(whole)
        keep = {0: 0, 1: self._open(whole), 2: self._open(whole), 3: 1}.get(state, 1) if state else 0
        self.state, self.rest = state, whole[len(whole) - keep:] if keep else b""
        return (whole[:len(whole) - keep] if keep else whole).decode("utf-8")

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes of the character begun at the end."""
        return next(k for k in range(1, 5) if data[-k] >= 0xC0)

    def _mend(self, whole: bytes) -> str:
        dec = codecs.getincrementaldecoder("utf-8")(errors="replace")
        text = dec.decode(whole)
        self.rest = dec.getstate()[0]
        self.state = 0
        for b in self.rest:
            self.state = int(_UTF8[self.state, b])
        return text

    def close(self) -> str:
        text, self.state, self.rest = self.rest.decode("utf-8", "replace"), 0, b""
        return text


#: Code points below this are told apart by plain classes, for which the standard engine is faster.
_PLAIN = 0x250


def _span(kind: str) -> str:
    """The code points below _PLAIN of a general category, as the inside of a character class."""
    own = [unicodedata.category(chr(c))[0] == kind for c in range(_PLAIN)] + [False]
    edges = [c for c in range(_PLAIN + 1) if own[c] != (c > 0 and own[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))


class Splitter:
    """All matches of a tokenizer's pattern; texts of plain code points go to the standard engine, others to regex."""

    def __init__(self, pattern: str):
        import regex
        space, letter, number = r"\t-\r \x85\xa0", _span("L"), _span("N")
        plain = pattern
        for was, now in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"),
                         (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
            plain = plain.replace(was, now)
        self.full, self.other = regex.compile(pattern), re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")
        # another pattern may hold what this doesn't translate
        self.plain = None if "\\p" in plain or "[[" in plain else re.compile(plain)

    def __call__(self, text: str):
        engine = self.full if self.plain is None or self.other.search(text) else self.plain
        # a very long text is split piece by piece, so that its pieces aren't all held
        return (m.group() for m in engine.finditer(text)) if len(text) > 1 << 20 else iter(engine.findall(text))


@lru_cache(maxsize=1)
def _tools(path: str, pattern: str):
    ranks = read_ranks(path)
    tools = _Pieces(Transducer(ranks)), Decoder(ranks), Splitter(pattern)
    # hundreds of thousands of tuples without cycles: nothing for the collector to find
    gc.freeze()
    gc.set_threshold(1_000_000, 20, 20)
    return tools


class _Pieces(dict):
    """Packed ids of pieces seen before; starts anew when it holds ``most``."""

    def __init__(self, machine: Transducer, most: int = 400_000):
        self.machine, self.most = machine, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def encode_text(text: str, pieces: _Pieces, split: Splitter, part: int = 1 << 16):
    """Packed ids of a whole text in parts of so many pieces; each match of the pattern is a piece."""
    found = split(text)
    while some := list(islice(found, part)):
        yield b"".join(map(pieces.__getitem__, some))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, same) and, if named in ``keep``, ``ids`` (array) and ``decoded``.

    ``same``: the decoded text is the text.
    """
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same boolean" + "".join(f", {k} {kinds[k]}" for k in keep)

    def run(batches):
        pieces, decoder, split = _tools(ranks_path, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, at, same = 0, 0, True
                h_ids, h_text, all_ids, all_text = hashlib.sha256(), hashlib.sha256(), [], []
                for packed in encode_text(text, pieces, split):
                    h_ids.update(packed)
                    ids = np.frombuffer(packed, "<u4")
                    n += len(ids)
                    back = decoder.feed(ids)
                    same = same and text.startswith(back, at)
                    at += len(back)
                    h_text.update(back.encode())
                    if "ids" in keep:
                        all_ids.extend(ids.tolist())
                    if "decoded" in keep:
                        all_text.append(back)
                back = decoder.close()
                h_text.update(back.encode())
                row = {"doc_id": doc_id, "n_tokens": n, "ids_sha256": h_ids.hexdigest(), "decoded_sha256": h_text.hexdigest(),
                       "same": same and not back and at == len(text)}
                out.append(row | {k: all_ids if k == "ids" else "".join(all_text) + back for k in keep})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same", pa.bool_())]
                + [(k, pa.list_(pa.int32()) if k == "ids" else pa.string()) for k in keep]))

    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)
