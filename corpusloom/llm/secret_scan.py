"""Secret scans: fixed patterns, and literals assigned to sensitive names.

Base spans are found by three patterns (assign, access, hex). On top, a small lexer reads assignments of source and
configuration syntax (name = "x", name: x, "name": "x", name := x, name => x, attributes) into name-literal pairs,
resolves names that were given a literal before (constants) and joins of literals with +, and scores each literal by
its target's name and its own form; literals of LEAST_SCORE or more give spans of kind `literal`.

Null texts are empty: no spans. Repeated rows keep a row each. An empty table gives an empty result. Extra columns are
dropped. Joined values of over LONGEST characters are scored by how often they have each character and by their ends, so
that constants that are doubled line by line cost a line each. Texts of any length are read whole; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices

#: The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ORDER = ("assign", "access", "hex", "literal")
#: Scores of name parts, and literals that stand for no secret.
NAME_SCORES = {"password": 5, "passwd": 5, "pwd": 5, "passphrase": 5, "secret": 5, "token": 4, "credential": 4, "credentials": 4, "apikey": 5, "privatekey": 5, "auth": 2, "bearer": 3, "key": 2, "api": 2, "access": 1, "private": 2, "signing": 2, "session": 1, "encryption": 2, "client": 1}
PLACEHOLDERS = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|todo|changeme|example.*|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")
LEAST_SCORE = 7
#: Characters of a joined value that are kept as text, and of each end of a longer one.
LONGEST, ENDS = 256, 64
_HEX_ONLY = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_MARK = re.compile(r"[:=]")
_NAME = re.compile(r"""[A-Za-z_][A-Za-z0-9_.\-]*\Z""")
_TERM = re.compile(r"""\x20*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([A-Za-z_][A-Za-z0-9_.]*)(?=[\s;,)}\]+]|\Z)|([^\s"'`;,<>(){}\[\]]+))""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PART.findall(name)]
    return sum(NAME_SCORES.get(p, 0) for p in set(parts)) + max([0, *(NAME_SCORES[a + b] for a, b in zip(parts, parts[1:], strict=False) if a + b in NAME_SCORES)])


class Long:
    """What scoring needs of a joined value of over LONGEST characters: how often it has each, and its ends.

    These add up, so that constants joined to themselves over and over cost no more than any other. The numbers are
    exact up to 2^512; beyond, all are shortened alike.
    """

    __slots__ = ("counts", "head", "tail")

    def __init__(self, counts: dict[str, int], head: str, tail: str):
        self.counts, self.head, self.tail = counts, head, tail

    def __len__(self) -> int:
        return min(sum(self.counts.values()), sys.maxsize)


def join(a: str | Long, b: str | Long) -> str | Long:
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LONGEST:
        return a + b
    (x, head_a, tail_a), (y, head_b, tail_b) = ((Counter(v), v, v) if isinstance(v, str) else (v.counts, v.head, v.tail) for v in (a, b))
    counts = {k: x.get(k, 0) + y.get(k, 0) for k in {*x, *y}}
    while sum(counts.values()) >> 512:
        counts = {k: max(1, v >> 256) for k, v in counts.items()}
    return Long(counts, (head_a + head_b)[:ENDS], (tail_a + tail_b)[-ENDS:])


def literal_score(value: str | Long) -> int:
    """0 for what can't be a secret; else a score of length, kinds of characters and entropy."""
    if isinstance(value, str):
        counts, shape = Counter(value), value
    else:
        # between the ends one more character, so that a run of one character isn't taken for all
        counts = value.counts
        shape = value.head + next((c for c in counts if c not in value.head), value.head[0]) + value.tail
    if len(value) < 6 or PLACEHOLDERS.match(shape):
        return 0
    n = sum(counts.values())
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    letters = "".join(counts)
    kinds = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return 1 + (n >= 12) + (n >= 20) + (entropy >= 3) + (entropy >= 4) + (kinds >= 2) + (kinds >= 3) - 3 * (" " in counts)


def name_before(text: str, at: int) -> str:
    """The whole name that ends before place at, behind blanks, the colon of `:=`, quotes and a closing bracket; "" if there is none."""
    i = at
    for marks in (" ", ":", " ", '"', "'", "]", '"', "'"):
        while i and text[i - 1] == marks:
            i -= 1
            if marks != " ":
                break
    j = i
    while j and (text[j - 1].isascii() and text[j - 1].isalnum() or text[j - 1] in "_.$-"):
        j -= 1
    name = _NAME.search(text[j:i])
    return name[0] if name else ""


def lex(text: str) -> list[tuple[int, int, str, str | Long]]:
    """(start, end, name, value) of every assigned literal; the value of a known name or a join is its text, or a Long."""
    constants: dict[str, str | Long] = {}
    out, done = [], 0
    for m in _MARK.finditer(text):
        at = m.start()
        if at < done:
            continue
        name = name_before(text, at)
        if not name:
            continue
        i = at + 1
        while i < len(text) and text[i] in "=>":
            i += 1
        if text[i : i + 2] == "//":  # a URL
            continue
        value, spans = "", []
        while t := _TERM.match(text, i):
            quoted = t[1] if t[1] is not None else t[2] if t[2] is not None else t[3]
            if quoted is not None:
                value = join(value, quoted) if value else quoted
                spans.append(t.span(1 if t[1] is not None else 2 if t[2] is not None else 3))
            elif t[4] is not None and t[4] in constants:
                value = join(value, constants[t[4]]) if value else constants[t[4]]
                spans.append(t.span(4))
            else:
                plain = t[4] if t[4] is not None else t[5]
                value = join(value, plain) if value else plain
                spans.append(t.span(4 if t[4] is not None else 5))
            i = t.end()
            more = re.compile(r"\x20*\+").match(text, i)
            if not more:
                break
            i = more.end()
        if spans:
            constants[name] = value
            out.append((spans[0][0], spans[-1][1], name, value))
            done = spans[-1][1] if spans[-1][1] > at and text[spans[0][0] - 1 : spans[0][0]] in ('"', "'", "`") else done
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_ONLY):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], ORDER.index(s[0])))


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    found = {}
    for a, b, name, value in lex(text):
        n = name_score(name)
        s = literal_score(value) if n else 0
        if s > 0 and n + s >= LEAST_SCORE:
            found[a, b] = ("literal", a, b)
    return list(found.values())


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): array of (kind, start, end) by start, then kind."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _ in slices(batches, "t"):
            rows = []
            for t in piece.column("t").to_pylist():
                t = t or ""
                spans = sorted(base_spans(t) + literal_spans(t), key=lambda s: (s[1], ORDER.index(s[0]), s[2]))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.record_batch([piece.column("id"), pa.array(rows, kind)], [id_col, "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind: string, start: int, end: int>>")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) of every document."""
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, ORDER[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(ORDER[3]))


