"""Secret scans: known forms of credentials, and strings whose characters look drawn at random.

Candidates are unbroken runs of key characters. Over each candidate a window slides; for each character class the
window's Shannon entropy follows from the counts of its characters, of which each step adds one and takes one
away. Windows above the class's threshold join into a span, unless the allow-list knows the candidate or a part that they touch.

Spans are in code points, end exclusive. Results for odd input: a null or empty text has no spans; a null id gives
a row with a null id; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import text_rows

#: Order of kinds where spans begin together.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are as long as can be, so this finds those of [0-9a-f]+ that count
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Candidates that are no secrets as a whole, however random they look.
ALLOW = (
    r"[0-9]+",                                                                    # numbers
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"[A-Za-z]+([-_/][A-Za-z]+)*",                                                # words, joined words, paths
    r"(?i)(abcdefghijklmnopqrstuvwxyz|0123456789(abcdef)?|qwertyuiop)+",          # alphabets
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-]?[0-9]{2,6}([-+][0-9]{2,4})?Z?)?",          # dates, with a time
)

#: Parts of candidates: windows that touch one are no secrets, the others of the candidate may be.
TOUCH = (
    r"(?i)example|placeholder|changeme|your[_-]?key",                             # stand-ins
    r"(?i)(abcdefghijklmnop(qrstuvwxyz)?|0123456789(abcdef)?|qwertyuiop)+",       # alphabets
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",                                               # leading dates
)


@dataclass(frozen=True)
class CharClass:
    """Characters, and the bits per character that a window of them must reach."""
    name: str
    characters: str
    threshold: float
    #: digits that a window must hold at least; words hold none
    digits: int = 0


#: For windows of 20 characters: random hex has about 3.4 bits, random base-64 about 4.1, prose about 3.3.
#: Uniformly random strings of 20 that all classes miss, of 20,000 each: a-z0-9 1.1 %, A-Z2-7 3.4 %, A-Z0-9 1.1 %,
#: A-Za-z0-9 5.1 %. Of 20,000 runs of 19 letters of prose without its spaces, and a digit, 16 % are taken for secrets.
CLASSES = (CharClass("hex", "0123456789abcdefABCDEF", 3.0),
           CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.9),
           CharClass("lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4, 1),
           CharClass("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4, 1),
           CharClass("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.7, 1))


@dataclass(frozen=True)
class Scan:
    window: int = 20
    classes: tuple[CharClass, ...] = CLASSES
    allow: tuple[str, ...] = ALLOW
    touch: tuple[str, ...] = TOUCH


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the known forms."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class EntropyScan:
    def __init__(self, scan: Scan):
        self.scan = scan
        every = "".join(sorted({c for k in scan.classes for c in k.characters}))
        self.candidate = re.compile(f"[{re.escape(every)}]{{{scan.window},}}")
        self.allow = [re.compile(a) for a in scan.allow]
        self.touch = [re.compile(a) for a in scan.touch]
        w = scan.window
        plogp = [0.0] + [c * log2(c) for c in range(1, w + 1)]
        #: what one more of a character adds to the sum of c*log2(c)
        self.gain = [plogp[c + 1] - plogp[c] for c in range(w)]
        # entropy = log2(w) - sum(c*log2(c)) / w, so a threshold is a bound on the sum
        self.bound = [(frozenset(k.characters), (log2(w) - k.threshold) * w + 1e-9, k.digits) for k in scan.classes]

    def windows(self, run: str, characters: frozenset, bound: float, digits: int = 0):
        """Starts of the windows of ``characters`` alone, with so many digits, whose entropy reaches the threshold."""
        w, gain = self.scan.window, self.gain
        counts: dict[str, int] = {}
        total, have, numeric = 0.0, 0, 0
        for i, c in enumerate(run):
            if c not in characters:
                counts, total, have, numeric = {}, 0.0, 0, 0
                continue
            if have == w:
                old = run[i - w]
                counts[old] -= 1
                total -= gain[counts[old]]
                have -= 1
                numeric -= "0" <= old <= "9"
            k = counts.get(c, 0)
            total += gain[k]
            counts[c] = k + 1
            have += 1
            numeric += "0" <= c <= "9"
            if have == w and total <= bound and numeric >= digits:
                yield i - w + 1

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for m in self.candidate.finditer(text):
            run = m.group()
            if any(a.fullmatch(run) for a in self.allow):
                continue
            known = [x.span() for a in self.touch for x in a.finditer(run)]
            hits = sorted({s for k in self.bound for s in self.windows(run, *k) if all(s >= b or s + self.scan.window <= a for a, b in known)})
            at = None
            for s in hits:
                if at and s <= at[1]:
                    at[1] = s + self.scan.window
                else:
                    at = [s, s + self.scan.window]
                    out.append(at)
                    at.append(m.start())
        return [(a + base, 3, b + base) for a, b, base in out]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every document, by start, then in the order of KINDS."""
    def run(batches):
        entropy = EntropyScan(scan)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(t) + entropy.spans(t))]
                    for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "spans"])
    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each covered run of characters replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if b <= at:
            continue
        out += [text[at:a], f"<{KINDS[k]}>"] if a >= at else []
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, scan: Scan = Scan(), text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets masked in the text; a null text stays null."""
    schema = docs.schema

    def run(batches):
        entropy = EntropyScan(scan)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else masked(t, base_spans(t) + entropy.spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(run, schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as text."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("spans", lambda x: x.kind != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
