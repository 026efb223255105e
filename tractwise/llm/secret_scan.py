"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration syntax."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns every scan has to report, and the least length of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

KINDS = ("assign", "access", "hex", "literal")  # in the order of spans that start together

#: Parts of a target's name and how much each says that its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "client_secret": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signing_key": 0.9, "encryption_key": 0.9,
    "connection_string": 0.7, "dsn": 0.6,
}
#: What a document must hold, in lower case, for its syntax to be read at all.
STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"connection", b"dsn")
PLACEHOLDERS = ("example", "changeme", "change_me", "placeholder", "your", "dummy", "sample", "xxxx", "****", "none",
                "null", "true", "false", "todo", "redacted", "undefined")
LEAST_SCORE = 0.6
SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

# A name, perhaps quoted or at the end of a path of members, and, where one follows, an assignment sign. A name without
# a sign is passed over whole, as no later part of it can have one: that keeps the scan linear.
PAIR = r"""(?<![\w$])(?:--|\$)?(?P<name>[A-Za-z_][\w.\-]*+(?:\[["'][\w.\-]++["']\])?+)(?P<sign>["']?[ \t]*+(?::=|=>|==?|:(?!:))[ \t]*+(?=\S))?"""
TRIPLE = r"""[bfruBFRU]{0,2}(?:\"\"\"(?P<td>[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+)\"\"\"|'''(?P<ts>[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+)''')"""
STRING = r"""[bfruBFRU]{0,2}(?:"(?P<d>[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+)'|`(?P<b>[^`]*+)`)"""
KEY = r"-----BEGIN [^\n-]*+-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [^\n-]*+-----"
PEM = rf"""(?P<q>["'])(?P<pem>{KEY})(?:\\n|\s)*+(?P=q)|(?P<plain>{KEY})"""
BLOCK = r"""[|>][-+0-9]{0,2}[ \t]*+(?:#[^\n]*+)?\r?\n"""  # the head of a block scalar
BARE = r"""[^\s,;"'`<>(){}\[\]&|#]+"""
PLUS = r"""[ \t]*(?:\+|\.(?=[ \t]*["'])|(?=["']))[ \t]*"""
INNER = r"\$\{(\w+)\}|\{(\w+)\}|%\((\w+)\)s|\$(\w+)"


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Leftmost matches of each fixed pattern that are long enough."""
    found = []
    for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= ASSIGN_LEAST:
            found.append(("assign", *m.span(), 1.0))
    for m in re.finditer(ACCESS, text):
        if len(m[0]) >= ACCESS_LEAST:
            found.append(("access", *m.span(), 1.0))
    # a run of the characters is one match, so the long runs are those with that many in a row
    for m in re.finditer(HEX.replace("+", "{%d,}" % HEX_LEAST), text):
        found.append(("hex", *m.span(), 1.0))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def name_score(name: str) -> float:
    """The largest weight of the name's last parts, in snake, kebab, dotted or camel case."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    parts = [p for p in re.split(r"[^a-z0-9]+", parts) if p]
    best = 0.0
    for i in range(len(parts)):
        for j in range(i + 1, min(len(parts), i + 2) + 1):
            weight = SENSITIVE.get("_".join(parts[i:j]), 0.0)
            best = max(best, weight * (1.0 if j == len(parts) else 0.6))
    return best


class Summary:
    """What the score of a text depends on, so that sums need not be put together: they can double with every line."""

    EDGE = max(map(len, PLACEHOLDERS)) - 1

    def __init__(self, text: str = ""):
        low = text.lower()
        self.n, self.counts, self.first = len(text), Counter(text), text[:1]
        self.dull, self.begin, self.end = any(p in low for p in PLACEHOLDERS), low[:self.EDGE], low[-self.EDGE:]

    def add(self, other: Summary) -> None:
        """Put the other text behind this one."""
        across = self.end + other.begin
        self.dull = self.dull or other.dull or any(p in across for p in PLACEHOLDERS)
        self.n, self.first = self.n + other.n, self.first or other.first
        self.counts.update(other.counts)
        self.begin = (self.begin + other.begin)[:self.EDGE] if len(self.begin) < self.EDGE else self.begin
        self.end = (self.end + other.end)[-self.EDGE:]

    def score(self) -> float:
        """How far a literal looks like a generated value and not like a word or a placeholder."""
        open_ = self.first and self.first in "<[{$%" and "\n" not in self.counts
        if self.n < 8 or self.dull or open_ or len(self.counts) < 4:
            return 0.0
        shares = [c / self.n for c in self.counts.values()]
        entropy = -sum(x * math.log2(x) for x in shares if x)
        every = "".join(self.counts)
        classes = sum(bool(re.search(c, every)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
        spaces = self.counts[" "] / self.n
        return max(0.0, min(1.0, 0.25 * min(entropy, 4.0) + 0.1 * (classes - 1) - 2.0 * spaces - (0.4 if classes == 1 else 0.0)))


def value_score(value: str) -> float:
    return Summary(value).score()


class Literal:
    """A value: pieces of the document and earlier literals, in their order, and the places of its own.

    Earlier literals are links, not copies, so what a name holds needs no limit.
    """

    def __init__(self):
        self.parts: list[tuple[int, int] | Literal] = []
        self.spans: list[tuple[int, int]] = []
        self.points, self._summary = 0.0, None

    def summary(self, text: str) -> Summary:
        waiting = [self]
        while waiting:
            at = waiting[-1]
            missing = [x for x in at.parts if isinstance(x, Literal) and x._summary is None] if at._summary is None else []
            if missing:
                waiting += missing
                continue
            if at._summary is None:
                own = Summary()
                for x in at.parts:
                    own.add(x._summary if isinstance(x, Literal) else Summary(text[x[0]:x[1]]))
                at._summary = own
            waiting.pop()
        return self._summary


def _expression(text: str, at: int, known: dict[str, Literal]) -> Literal | None:
    """A sum of string literals and known names, from ``at`` on."""
    out = Literal()
    triple, pem, string, bare, plus = map(re.compile, (TRIPLE, PEM, STRING, BARE, PLUS))
    while True:
        m = triple.match(text, at) or string.match(text, at) or pem.match(text, at)
        if m:
            start, end = m.span(m.lastgroup)
            if start < end:
                out.spans.append((start, end))
            done = start
            for x in re.compile(INNER).finditer(text, start, end):
                name = next(g for g in x.groups() if g)
                if name in known:
                    out.parts += [(done, x.start()), known[name]]
                    done = x.end()
            out.parts.append((done, end))
        else:
            m = bare.match(text, at)
            if not m:
                break
            value = m[0].rstrip(".:")
            name = value.removeprefix("$")
            if name in known:
                out.parts.append(known[name])
            elif not out.parts:
                out.parts.append((m.start(), m.start() + len(value)))
                out.spans.append((m.start(), m.start() + len(value)))
            else:
                break
        more = plus.match(text, m.end())
        if not more:
            break
        at = more.end()
    return out if out.parts else None


def _block(text: str, key: int, at: int) -> Literal | None:
    """The block scalar whose head stands at ``at``: the lines indented deeper than the line of its key."""
    head = re.compile(BLOCK).match(text, at)
    if not head:
        return None
    line = text.rfind("\n", 0, key) + 1
    depth = re.compile(r"[ \t]*+(?:-[ \t]++)*+").match(text, line).end() - line
    out, at, row = Literal(), head.end(), re.compile(r"([ \t]*+)([^\n]*+)\n?")
    while at < len(text):
        m = row.match(text, at)
        if m[2].strip():
            if len(m[1]) <= depth:
                break
            out.parts.append((m.start(2), m.end()))
            last = m.start(2) + len(m[2].rstrip())
        at = m.end()
    if out.parts:
        out.parts[-1] = (out.parts[-1][0], last)
        out.spans.append((out.parts[0][0], last))
    return out if out.parts else None


def literal_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Literals that reach a target with a sensitive name, directly or over other names."""
    known: dict[str, Literal] = {}
    literals: list[Literal] = []
    for m in re.finditer(PAIR, text):
        if m["sign"] is None:
            continue
        literal = (_block(text, m.start(), m.end()) if ":" in m["sign"] else None) or _expression(text, m.end(), known)
        if literal is None:
            continue
        literals.append(literal)
        name = m["name"]
        short = re.split(r"[.\[]", name)[-1].strip("\"']")
        known[name] = known[short] = literal
        weight = max(name_score(name), name_score(short))
        points = weight * literal.summary(text).score() if weight else 0.0
        literal.points = round(points, 6) if points >= LEAST_SCORE else 0.0
    found: dict[tuple[int, int], float] = {}
    for literal in reversed(literals):  # links lead to earlier ones only
        if literal.points:
            for span in literal.spans:
                found[span] = max(found.get(span, 0.0), literal.points)
            for x in literal.parts:
                if isinstance(x, Literal):
                    x.points = max(x.points, literal.points)
    return [("literal", s, e, p) for (s, e), p in found.items()]


def find(text: str | None, raw: bytes | None = None) -> list[tuple[str, int, int, float]]:
    """All spans, in order; a literal inside a span of a fixed assignment isn't told twice."""
    if not text:
        return []
    base = base_spans(text)
    low = (raw if raw is not None else text.encode()).lower()
    if (b"=" not in low and b":" not in low) or not any(s in low for s in STEMS):
        return base
    held = sorted((s, e) for k, s, e, _ in base if k == "assign")  # they don't overlap, so one of them at most can hold a literal
    own = []
    for x in literal_spans(text):
        at = bisect_right(held, x[1], key=lambda h: h[0])
        if not at or x[2] > held[at - 1][1]:
            own.append(x)
    return sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end in code points, score) of every document.

    Null and empty texts have no spans; repeated rows are each scanned; other columns are ignored.
    Neither texts nor names, values, sums and constants have limits. Triple-quoted strings, template
    strings, block scalars and PEM keys may go over lines; other quotes end on their line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                out.append([dict(zip(("kind", "start", "end", "score"), x)) for x in find(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, spans {SPANS}")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, told by kind and joined."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = F.filter("spans", lambda x: x.kind != "literal")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
