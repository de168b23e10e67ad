"""Secret scans: base patterns, and assignment-aware lexing with constants carried to sensitive names."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Kinds in the order that breaks ties; the last one is the lexer's.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Parts of names that hold secrets, with their weights.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "accesskey": 3.0,
             "privatekey": 3.0, "credential": 2.5, "authorization": 2.0, "auth": 1.5, "signature": 1.5, "salt": 1.0}
#: Ends of names whose secrets may be words with blanks between them.
PHRASES = ("passphrase",)
THRESHOLD = 5.0
MIN_LITERAL = 8
#: A statement: a name, perhaps quoted, an assignment sign, and what follows as its expression.
STATEMENT = re.compile(r"""(?:^|[\s{,;(&?])(?:["']([A-Za-z_][\w.\-]*)["']|([A-Za-z_][\w.\-]*))[ \t]*(:=|=>|\+=|=(?!=)|:(?![:/]))[ \t]*""", re.ASCII)
TERM = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|([A-Za-z_][\w.\-]*(?![\w+/=]))|([A-Za-z0-9+/_=.\-]+)""", re.ASCII)
INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}")
BLANKS = r"(?:[ \t]|\\?\r?\n)*"
#: Between terms: a joining sign, after which the line may end; prose ends sentences with a dot right behind a quote. Inside parentheses lines end anywhere.
JOIN = re.compile(rf"[ \t]*(?:(?:\+|\.\.|(?<=[ \t])\.(?=[ \t\r\n])){BLANKS}|\.(?=[ \t])[ \t]*)")
INNER_JOIN = re.compile(rf"{BLANKS}(\+|\.\.|\.(?=[ \t\r\n]))?{BLANKS}")
OPEN, CLOSE = re.compile(rf"\({BLANKS}"), re.compile(rf"{BLANKS}\)")

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """Weight of the most sensitive part of a target name; its last dotted part counts, separators do not."""
    plain = re.sub(r"[_\-]", "", name.rsplit(".", 1)[-1].lower())
    return max((w for part, w in SENSITIVE.items() if part in plain), default=0.0)


def is_phrase(name: str) -> bool:
    return re.sub(r"[_\-]", "", name.lower()).endswith(PHRASES)


def value_score(value: Counter[str], phrase: bool = False) -> float:
    """How much a value, given as its character counts, looks like a secret: bits per character, kinds of characters, no blanks unless it is a phrase, some length."""
    length = value.total()
    if length < MIN_LITERAL or not phrase and any(c.isspace() for c in value):
        return 0.0
    bits = -sum(p * math.log2(p) for n in value.values() if (p := n / length))
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(bits, 4.0) * 0.5 + min(kinds, 3) * 0.5 + (0.5 if length >= 16 else 0.0)


class Origin:
    """The literal spans that a value came from: its own and, by links, those of the constants it was made of."""
    __slots__ = ("own", "parents", "marked")

    def __init__(self, own: tuple[Span, ...], parents: tuple[Origin, ...]):
        self.own, self.parents, self.marked = own, parents, False

    def mark(self, found: set[Span]) -> None:
        """Put all spans into ``found``; what has been marked is not walked again."""
        todo = [self]
        while todo:
            node = todo.pop()
            if not node.marked:
                node.marked = True
                found.update(s for s in node.own if s[1] > s[0])
                todo += node.parents


def statements(text: str):
    """(name, terms, whether they are appended) of each assignment; a term is (kind, value, span) of a literal or of a name that is used.

    Terms are joined by signs, over line ends after a sign and anywhere in parentheses, where literals also join
    without one. What starts another statement behind a line end or a parenthesis is no term.
    """
    at = 0
    while m := STATEMENT.search(text, at):
        terms, depth, crossed, at = [], 0, False, m.end()
        here = at
        while True:
            opened = False
            while p := OPEN.match(text, here):
                depth, opened, here = depth + 1, True, p.end()
            if (opened or crossed) and STATEMENT.match(text, here - 1):
                break
            t = TERM.match(text, here)
            if t is None or crossed and t.lastindex == 6:
                break
            group = t.lastindex
            kind = "literal" if group in (1, 2) else "name" if group in (3, 4, 5) else "bare"
            terms.append((kind, t.group(group), t.span(group)))
            at = t.end()
            while depth and (p := CLOSE.match(text, at)):
                depth, at = depth - 1, p.end()
            gap = INNER_JOIN.match(text, at) if depth else JOIN.match(text, at)
            if gap is None:
                break
            here = gap.end()
            if depth and gap[1] is None and not (kind == "literal" and text.startswith(("\"", "'"), here)):
                break
            crossed = "\n" in gap[0]
        yield m.group(1) or m.group(2), terms, m.group(3) == "+="


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through constants.

    Statements are read in order; of each name's current value, its character counts and the origin of its spans
    are held, which add up exactly however long the value is and however many pieces it has. Joined and
    appended terms, names that hold constants and ``${name}`` inside strings are carried along; an assignment whose
    name and whole value together score enough marks every literal span that the value came from.
    """
    if "=" not in text and ":" not in text:
        return []
    held: dict[str, tuple[Counter[str], Origin]] = {}
    found: set[Span] = set()
    for name, terms, appended in statements(text):
        value, own, parents, known = Counter(), [], {}, bool(terms) and (not appended or name in held)
        if known and appended:
            value.update(held[name][0])
            parents[held[name][1]] = None
        for kind, raw, span in terms:
            if kind == "name":
                if raw in held:
                    value.update(held[raw][0])
                    parents[held[raw][1]] = None
                elif len(terms) == 1 and not appended and "." not in raw and any(map(str.isdigit, raw)) and text[span[1]:span[1] + 1] not in ("(", "["):
                    value.update(raw)
                    own.append(span)
                else:
                    known = False
                    break
                continue
            inner = [held[n] for n in INSIDE.findall(raw) if n in held]
            rest = INSIDE.sub(lambda m: "" if m[1] in held else m[0], raw) if inner else raw
            value.update(rest)
            for counts, origin in inner:
                value.update(counts)
                parents[origin] = None
            if not inner or INSIDE.sub("", raw):
                own.append(span)
        if not known:
            held.pop(name, None)
            continue
        held[name] = value, Origin(tuple(own), tuple(parents))
        weight = name_score(name)
        if weight and weight + value_score(value, is_phrase(name)) >= THRESHOLD:
            held[name][1].mark(found)
    return [(a, b, 3) for a, b in found]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def all_spans(text: str) -> tuple[list, list]:
    """Base spans and all spans of a whole text, by start, then by kind as listed."""
    order = lambda s: (s[0], s[2], s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + literal_spans(text), key=order)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text (null: empty, so no spans).

    Spans are code points, ends exclusive. Rows are independent, repeats give repeats, other columns are ignored.
    """
    def work(batches):
        for batch in batches:
            rows = []
            for value in batch["text"]:
                base, every = all_spans(value.as_py() or "")
                n = Counter(s[2] for s in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return map_batches(texts_of(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mask: str = "[secret]") -> str:
    """``text`` with each run of touching spans replaced by ``mask``."""
    out, done = [], 0
    for start, end, _ in all_spans(text)[1]:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked in text, and n_chars, where there is one, counted anew for changed texts."""
    names = docs.columns

    def work(batches):
        for batch in batches:
            old = batch["text"].to_pylist()
            new = [t if t is None else masked(t, mask) for t in old]
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                kind = batch.schema.field("n_chars").type
                columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)
    return docs.mapInArrow(work, docs.schema)
