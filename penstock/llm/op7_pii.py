"""Personal data: base patterns, and a skip-chain conditional random field that adds what is consistent with them.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and non-overlapping per kind. The field works on candidate
tokens: words that hold a digit or an `@` once the punctuation around them is off, and phone numbers whose parts are words of
their own count as one token. Every other word has label `none` by definition. Labels are `none` and the four kinds. Potentials:

* a token's shape (features below) with its label,
* neighbouring candidates of one document (the chain),
* repeated or similar tokens anywhere in the document (the skips): equal tokens, and tokens with the same digits, form a group.

Each group hangs on a hub that passes its members' evidence on, so a group of n costs n messages and not n * n. Sum-product message
passing runs `ROUNDS` times over chain and hubs. A token whose most probable label is a kind, with probability `LEAST` or more, and
which no base span touches, gives an added span. So a card number that is broken up by dots, say, is found where the
document repeats the same digits in a valid form. Tokens of base spans are observed: their label is pinned. Base spans stay whatever the field says.

Weights are fitted here, by pseudo-likelihood on a bounded sample (`FIT_DOCS` documents, chosen by a hash of the id) whose labels are the base
spans; of the base checks, the features hold only that a number of 13 to 19 digits fails Luhn's. Counts and spans cover every document and whole texts.

Results: a null text is empty and has no spans; a null id is kept; each row is judged by its text alone, so repeated rows agree; ties between
labels go to the earlier label; on an empty table the field has zero weights and adds nothing. Other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import in_arrow, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FIT_DOCS, FIT_LINES, FIT_CHARS = 4000, 20, 500
ROUNDS, LEAST, SKIP, PINNED = 3, 0.8, 6.0, 12.0

# Possessive forms of the given patterns: what follows a run never matches a shorter run, so results are the same, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_HEAD = re.compile(r"\+[0-9]([ ().0-9-]++)")
_HIT = re.compile(r"[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*+")
_PHONE_LIKE = re.compile(r"\+[0-9][0-9 ().-]*[0-9]")
_SPACES = frozenset(" \t\n\v\f\r")
_EDGES = "!\"#$%&'()*,-./:;<=>?[\\]^_`{|}~"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def _phones(text: str) -> list[Span]:
    found, at = [], 0
    while (head := _PHONE_HEAD.search(text, at)) is not None:
        body = head[1]
        end = len(body)
        while end and not ("0" <= body[end - 1] <= "9"):
            end -= 1
        if end < 2:  # the pattern needs one more sign before the last digit
            at = head.start() + 1
            continue
        stop = head.start(1) + end
        if 9 <= sum("0" <= c <= "9" for c in text[head.start() : stop]) <= 15:
            found.append(("phone", head.start(), stop))
        at = stop
    return found


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 30) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + (_phones(text) if "+" in text else [])


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str


def candidates(text: str) -> list[Token]:
    found, done = [], 0
    hit = _HIT.search(text)
    while hit is not None:
        start = hit.start()
        while start > done and text[start - 1] not in _SPACES:
            start -= 1
        end = _REST.match(text, hit.start()).end()
        while start < end and text[start] in _EDGES:
            start += 1
        spaced = (_PHONE_LIKE if text[start] == "+" else _CARD).match(text, start)  # parts that are words of their own
        done = max(end, spaced.end()) if spaced else end
        end = spaced.end() if spaced and spaced.end() > end else end
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if start < end:
            found.append(Token(start, end, text[start:end]))
        hit = _HIT.search(text, done)
    return found


FEATURES = (
    "always", "at", "at_dot_after", "starts_plus", "brackets", "three_dots", "some_dots", "letters", "only_digits", "digits_to_5", "digits_6_8",
    "digits_9_12", "digits_13_19", "digits_20_up", "grouped", "parts_to_255", "quotes_or_equals", "fails_luhn",
)


def features(token: str) -> list[float]:
    number = "".join(c for c in token if "0" <= c <= "9")
    digits = len(number)
    at, dots = token.find("@"), token.count(".")
    pieces = re.split(r"[^0-9]+", token)
    return [
        1.0, at >= 0, at >= 0 and "." in token[at:], token[0] == "+", "(" in token, dots == 3, dots in (1, 2), any(c.isalpha() for c in token), digits == len(token),
        digits <= 5, 6 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits >= 20, " " in token or "-" in token,
        len(pieces) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in pieces), "=" in token or '"' in token,
        13 <= digits <= 19 and not luhn(number),
    ]


def groups(tokens: list[Token]) -> np.ndarray:
    """Group of each token: equal digits where there are six or more, else equal text in lower case; -1 for a token alone."""
    keys: dict[str, int] = {}
    of, sizes = [], []
    for t in tokens:
        digits = "".join(c for c in t.text if "0" <= c <= "9")
        key = digits if len(digits) > 5 and "@" not in t.text else t.text.lower()
        k = keys.setdefault(key, len(keys))
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        of.append(k)
    return np.array([k if sizes[k] > 1 else -1 for k in of], np.int64)


@dataclass(frozen=True)
class Field:
    """Log potentials: `own[feature, label]`, `chain[label, next label]` and `skip[label, label of the group]`."""

    own: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, shapes: np.ndarray, first: np.ndarray, group: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Probabilities by loopy sum-product. `first[i]`: token i begins a document; `seen`: observed labels, 0 where there is none. Groups
        never cross documents."""
        n, k = len(shapes), len(LABELS)
        local = shapes @ self.own
        if seen is not None:
            local = local + PINNED * np.eye(k)[seen] * (seen > 0)[:, None]
        ahead, back, hub = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        member = np.flatnonzero(group >= 0)
        if len(member):
            _, of = np.unique(group[member], return_inverse=True)
        linked = np.flatnonzero(~first)
        for _ in range(ROUNDS):
            out = local + hub
            message = _through(out[linked - 1] + ahead[linked - 1], self.chain)
            new_back = _through(out[linked] + back[linked], self.chain.T)
            ahead[linked], back[linked - 1] = message, new_back
            if len(member):
                up = _through(local[member] + ahead[member] + back[member], self.skip)
                total = np.zeros((of.max() + 1, k))
                np.add.at(total, of, up)
                hub[member] = _through(total[of] - up, self.skip.T)
        score = local + ahead + back + hub
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def _through(log: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Message over an edge: log of the sum over the sender's labels, scaled to a maximum of 0."""
    log = log - log.max(axis=1, keepdims=True) if len(log) else log
    out = np.log(np.exp(log) @ np.exp(potential) + 1e-300)
    return out - out.max(axis=1, keepdims=True) if len(out) else out


def _prepared(texts: list[str]) -> tuple[list[list[Span]], list[list[Token]], np.ndarray, np.ndarray, np.ndarray]:
    spans, tokens, shapes, first, group, offset = [], [], [], [], [], 0
    for text in texts:
        spans.append(base_spans(text))
        tokens.append(candidates(text))
        shapes += [features(t.text) for t in tokens[-1]]
        first += [k == 0 for k in range(len(tokens[-1]))]
        own = groups(tokens[-1])
        group.append(np.where(own >= 0, own + offset, -1))
        offset += len(tokens[-1])
    return spans, tokens, np.array(shapes, float).reshape(-1, len(FEATURES)), np.array(first, bool), np.concatenate(group) if group else np.zeros(0, np.int64)


def _labels(spans: list[Span], tokens: list[Token]) -> list[int]:
    """The kind of the first base span that lies over most of a token."""
    found, order = [], sorted(spans, key=lambda s: s[1])
    at = 0
    for t in tokens:
        while at < len(order) and order[at][2] <= t.start:
            at += 1
        label = 0
        for kind, start, end in order[at : at + 4]:
            if min(end, t.end) - max(start, t.start) > (t.end - t.start) / 2:
                label = LABELS.index(kind)
                break
        found.append(label)
    return found


def fit_field(texts: list[str], steps: int = 400, ridge: float = 1e-3) -> Field:
    """Pseudo-likelihood by gradient ascent: each token given its shape, its neighbours' labels and its group's other labels."""
    k = len(LABELS)
    spans, tokens, shapes, first, group = _prepared(texts)
    y = np.array([label for s, t in zip(spans, tokens, strict=True) for label in _labels(s, t)], np.int64)
    if not len(y):
        return Field(np.zeros((len(FEATURES), k)), np.zeros((k, k)), np.zeros((k, k)))
    truth = np.eye(k)[y]
    before, after = np.zeros_like(truth), np.zeros_like(truth)
    linked = np.flatnonzero(~first)
    before[linked], after[linked - 1] = truth[linked - 1], truth[linked]
    weights = np.zeros((len(FEATURES) + 2 * k, k))
    x = np.hstack([shapes, before, after])
    rates, squares = 0.05, np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = x @ weights
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (truth - p) / len(y) - ridge * weights
        squares = 0.99 * squares + 0.01 * slope**2
        weights += rates * slope / (np.sqrt(squares / (1 - 0.99**step)) + 1e-6)
    f = len(FEATURES)
    chain = (weights[f : f + k] + weights[f + k :].T) / 2
    skip = SKIP * np.eye(k)  # label consistency of a group: one strength for all labels, a documented parameter
    return Field(weights[:f], chain, skip)


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    spans, tokens, shapes, first, group = _prepared(texts)
    seen = np.array([label for s, t in zip(spans, tokens, strict=True) for label in _labels(s, t)], np.int64)
    best = field.beliefs(shapes, first, group, seen) if len(shapes) else np.zeros((0, len(LABELS)))
    kind, sure = best.argmax(axis=1), best.max(axis=1, initial=0.0)
    out, at = [], 0
    for own, words in zip(spans, tokens, strict=True):
        added = []
        taken = sorted((s[1], s[2]) for s in own)
        k = 0
        for t in words:
            while k < len(taken) and taken[k][1] <= t.start:
                k += 1
            free = not any(start < t.end and end > t.start for start, end in taken[k : k + 4])
            if kind[at] and sure[at] >= LEAST and free:
                added.append((LABELS[kind[at]], t.start, t.end))
            at += 1
        out.append((own, added))
    return out


def fit_on(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """Field fitted on a bounded sample of `docs`: of each document `FIT_LINES` lines with a digit or `@`, `FIT_CHARS` characters of each."""
    n = docs.count()
    part = docs.filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    if n > fit_docs:
        part = part.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_docs / n))
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9@]")), 1, FIT_LINES)
    rows = part.select("doc_id", F.transform(lines, lambda x: F.substring(x, 1, FIT_CHARS)).alias("lines"))
    return fit_field(["\n".join(r.lines) for r in rows.sort("doc_id", "lines").limit(fit_docs).collect()])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal(docs: DataFrame, field: Field) -> DataFrame:
    """`(doc_id, base, added)`: spans of each row's text, base spans in the order of kinds and starts."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batch: pa.RecordBatch):
        found = find_spans([t or "" for t in batch.column("text").to_pylist()], field)
        as_rows = lambda spans: [{"kind": s[0], "start": s[1], "end": s[2]} for s in spans]
        return {
            "doc_id": batch.column("doc_id"),
            "base": pa.array([as_rows(b) for b, _ in found], kind), "added": pa.array([as_rows(a) for _, a in found], kind),
        }

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), work, f"doc_id long, base {_SPANS}, added {_SPANS}")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal(docs, fit_on(docs))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    every = F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id", *[count(name) for name in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.sort_array(every)).alias("spans"),
    )
