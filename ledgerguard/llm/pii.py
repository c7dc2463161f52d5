"""Operator 4, personal data: pattern matches, and a skip-chain conditional random field on top.

Base spans come from patterns and checks.  The field adds spans that repeat personal data in another
shape: its nodes are a text's base spans and the other digit groups of at least ``MIN_DIGITS`` digits and
words that repeat the name part of a found address.  Potentials: a node's shape (learned from the counts
of shapes and labels over the whole corpus), neighbouring nodes (a weak tie), and skip edges between
tokens of the same form, however far apart (same last seven digits, same name part): from each to every
base node of its form, and between consecutive ones.  Loopy sum-product messages run over each text's
nodes; base nodes stay fixed, so that an edge to one is a constant and costs nothing.  Potentials of shapes
are bounded against label none so that one edge to a base node outweighs them.  A node of a base node's form
gets a span if its probability of being personal data reaches ``THRESHOLD``, of the likeliest kind that its
form has.

Defined cases: a null or empty text has no spans; a text of any length is read whole, in time linear in it;
overlapping spans of different kinds all stay, equal starts in the order of the kinds; repeated rows each give their row; an empty table gives
an empty result; other columns are ignored by the query and kept by the pipeline form.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import releasing, texts

KINDS = ["email", "ip", "card", "phone"]
MIN_DIGITS, MIN_NAME = 7, 6
THRESHOLD = 0.8
#: Bound of a shape's potential, tie of neighbours, and tie of equal forms (log odds).
SHAPE_BOUND, CHAIN, SKIP = 2.0, 0.1, 4.0
ROUNDS = 10

# The contract's patterns, cut at what can start and end a match, so that every text is scanned once:
# digits with what may stand between them; the part of an address after the @.
_DIGITS = re.compile(r"[0-9][0-9 .()-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD, _LETTER = re.compile(r"[\w.%+-]+", re.A), re.compile(r"\w", re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """(base spans as (start, kind, end), digit groups as (start, end, digits)) of a text."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    groups = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < MIN_DIGITS:
            continue  # too short for any kind: the shortest address has seven characters
        at, part = m.start(), m.group().rstrip(" .()-")
        for x in _IP.finditer(part):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in x.group().split(".")):
                spans.append((at + x.start(), 1, at + x.end()))
        for x in _CARD.finditer(part):
            digits = _NOT_DIGIT.sub("", x.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((at + x.start(), 2, at + x.end()))
        digits = _NOT_DIGIT.sub("", part)
        if at and text[at - 1] == "+" and len(part) > 2 and 9 <= len(digits) <= 15:
            spans.append((at - 1, 3, at + len(part)))
        if len(digits) >= MIN_DIGITS:
            groups.append((at, at + len(part), digits))
    spans.sort()
    return spans, groups


def _shape(text: str, start: int, end: int, digits: str) -> str:
    marks = "".join(c for c in "(.- " if text.find(c, start, end) >= 0)
    return f"{min(len(digits), 20)}{marks}"


def nodes(text: str, spans, groups) -> list[tuple[int, int, int, str, str]]:
    """(start, end, label or -1, shape, form) of a text's nodes, in order."""
    out, names = [], set()
    for a, kind, b in spans:
        if kind == 0:
            name = text[a:text.index("@", a)].lower()
            if len(name) >= MIN_NAME:
                names.add(name)
            out.append((a, b, 0, "@", name))
        else:
            digits = _NOT_DIGIT.sub("", text[a:b])
            out.append((a, b, kind, _shape(text, a, b, digits), digits[-7:] if kind != 1 else text[a:b]))
    starts = [a for a, _, _ in spans]
    reach = list(accumulate((b for _, _, b in spans), max))  # how far the spans up to each one reach
    for a, b, digits in groups:
        before = bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            out.append((a, b, -1, _shape(text, a, b, digits), digits[-7:]))
    out += [(a, b, -1, "@", text[a:b].lower()) for a, b in repeated_names(text, names)]
    out.sort()
    return out


def repeated_names(text: str, names: set[str]):
    """(start, end) of the words of a text that are one of the names, the longest that fits: neither the start nor the
    end may go on with a character of a name, but for a full stop at its end, and no @ may follow."""
    if not names:
        return
    heads, sizes = {n[:MIN_NAME] for n in names}, sorted({len(n) for n in names}, reverse=True)
    for m in _WORD.finditer(text):
        run = m.group()
        if run[:MIN_NAME].lower() not in heads:
            continue
        for size in sizes:
            if size < len(run):
                fits = run[size] == "." and not (size + 1 < len(run) and _LETTER.match(run, size + 1))
            else:
                fits = size == len(run) and not text.startswith("@", m.end())
            if fits and run[:size].lower() in names:
                yield m.start(), m.start() + size
                break


def _form(node) -> tuple[bool, str]:
    """What skip edges compare: names only with names."""
    return node[3] == "@", node[4]


def infer(found, potentials: dict[str, list[float]]) -> np.ndarray:
    """Probabilities (node x 1 + kinds; label 0 is none) by loopy messages with fixed base nodes."""
    n, k = len(found), len(KINDS) + 1
    unary = np.zeros((n, k))
    for i, (_, _, label, shape, _) in enumerate(found):
        unary[i] = potentials.get(shape, [0.0] * k)
        if label >= 0:
            unary[i] = -30.0
            unary[i, label + 1] = 30.0
        elif shape == "@":
            unary[i] = [SHAPE_BOUND, 0, -30, -30, -30]
        else:
            unary[i, 1] = -30.0
    edges, last, fixed = [(i, i + 1, CHAIN) for i in range(n - 1)], {}, {}
    for f in found:
        if f[2] >= 0:
            fixed.setdefault(_form(f), np.zeros(k))[f[2] + 1] += SKIP
    for i, f in enumerate(found):
        if f[2] >= 0:
            continue
        unary[i] += fixed.get(_form(f), 0.0)  # what the edges to all base nodes of the form say
        if _form(f) in last:
            edges.append((last[_form(f)], i, SKIP))
        last[_form(f)] = i
    if not edges:
        edges = [(0, 0, 0.0)]
    a, b, tie = (np.array(c) for c in zip(*edges))
    src, dst, tie = np.append(a, b), np.append(b, a), np.append(tie, tie)
    back = np.append(np.arange(len(a)) + len(a), np.arange(len(a)))
    message = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        top = out.max(1, keepdims=True)
        e = np.exp(out - top)
        new = np.log(e.sum(1, keepdims=True) + e * (np.exp(tie) - 1)[:, None])
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, dst, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Potentials of shapes: log ratios of label counts to those of none over all digit groups of the corpus,
    at most ``SHAPE_BOUND`` for or against a kind however large the corpus.  To the driver comes one row for each shape and label (at most 21 lengths x 16 marks x 5 labels)."""
    @releasing
    def count(batches):
        for batch in batches:
            c: dict[tuple[str, int], int] = {}
            for text in batch.column("text").to_pylist():
                spans, groups = scan(text)
                for _, _, label, shape, _ in nodes(text, [s for s in spans if s[1]], groups) if groups else ():
                    c[shape, label] = c.get((shape, label), 0) + 1
            keys = list(c)
            yield pa.record_batch([pa.array([s for s, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int32()),
                                   pa.array([c[x] for x in keys], pa.int64())], names=["shape", "label", "n"])

    rows = (texts(docs).select("text").mapInArrow(count, "shape string, label int, n long")
            .groupBy("shape", "label").agg(F.sum("n").alias("n")).collect())
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r["shape"], np.ones(len(KINDS) + 1))[r["label"] + 1] += r["n"]
    return {s: np.clip(np.log(v) - np.log(v[0]), -SHAPE_BOUND, SHAPE_BOUND).tolist() for s, v in table.items()}


def all_spans(text: str, potentials) -> tuple[list, list]:
    """(base spans, all spans) of a text as (start, kind, end), sorted."""
    if not text:
        return [], []
    spans, groups = scan(text)
    if not spans:
        return spans, spans  # nothing that a node could repeat
    found = nodes(text, spans, groups)
    if all(f[2] >= 0 for f in found):
        return spans, spans
    forms: dict[tuple[bool, str], set[int]] = {}  # a span is added only where it repeats a base span
    for f in found:
        if f[2] >= 0:
            forms.setdefault(_form(f), set()).add(f[2])
    p = infer(found, potentials)
    more = [(f[0], max(sorted(forms[_form(f)]), key=lambda k: q[k + 1]), f[1]) for f, q in zip(found, p)
            if f[2] < 0 and _form(f) in forms and q[1:].sum() >= THRESHOLD]
    return spans, sorted(spans + more)


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @releasing
    def run(batches):
        for batch in batches:
            got = [all_spans(t, sent.value) for t in batch.column("text").to_pylist()]
            counts = [[sum(s[1] == k for s in base) for base, _ in got] for k in range(len(KINDS))]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                                   pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in got], pa.string()),
                                   pa.array([_written(s) for _, s in got], pa.string())],
                                  names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                       "base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with every span replaced by <KIND>; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """Pipeline form: the documents with all spans masked in ``text`` (and n_chars, if there, renewed)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @releasing
    def run(batches):
        for batch in batches:
            new = [t and masked(t, all_spans(t, sent.value)[1]) for t in batch.column("text").to_pylist()]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
