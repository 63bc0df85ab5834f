"""Secret scans: fixed rules, and a conditional random field that adds spans.

Every token of a text is an observation of one chain. What a token says of
itself and of its neighbours depends on the token alone, so it is looked up per
distinct token, and the scores of all tokens of a batch are sums of a few
gathered rows. Stretches in which no path but "outside" can win, by a bound on
what tokens and transitions can add up to, are known without decoding; Viterbi
runs over the others. The tags are those of Viterbi over the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .crf import ChainCrf, Features, train, viterbi

#: The field is fitted on windows of about this many documents with a span of the rules at most, and as many without.
SAMPLE = 1500
#: Windows that are taken of one document, and tokens on each side of their middle.
WINDOWS, SIDE = 4, 9
DIM = 1 << 14
#: Nats by which the best tags of a span have to be better than outside: documents with secrets are over-represented in the sample.
MARGIN = 2.0
KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

# The rules that results are compared by.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# The same in Java's patterns.
_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_OTHER_SQL = "AKIA[A-Z0-9]{16}|[0-9a-f]{24}"


def has_span(text: str = "text") -> Column:
    """Whether base_spans() finds any."""
    return F.col(text).rlike(_OTHER_SQL) | F.exists(F.regexp_extract_all(text, F.lit(_ASSIGN_SQL), 1), lambda x: F.length(x) >= 6)


_TOKEN = re.compile(r"[\w+/-]+(?:\.+[\w+/-]+)*|[^\w\s]")
_KEYS = frozenset("password passwd passphrase passcode pass pwd secret token key apikey auth bearer credential credentials access private signature".split())
_CODE = frozenset("{}()[];=<>")
_LETTERS = re.compile("[a-z]+")
_NO_SIGNS = str.maketrans("", "", "+/_.-")
_HEX_CHARS = frozenset("0123456789abcdef")
#: What a token is made of: conjunctions with features of its place are made with this.
TOKEN_KINDS = ("edge", "sign", "lower", "title", "upper", "letters", "joined", "digits", "hex", "caps", "mixed", "other")
#: A token says something of itself, of those that follow it by 1, 2 and 3, and of those 1 and 2 before it.
ROLES = ("own", "after1", "after2", "after3", "before1", "before2")
_SHIFTS = (0, 1, 2, 3, -1, -2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


class Make(NamedTuple):
    """What the field sees of a token; very many tokens share one."""

    kind: str
    shape: str = ""  # runs of capitals, small letters, digits and signs, each as one character, at most eight of them
    length: int = 0  # in fours
    distinct: int = 0  # characters, in twos
    digits: int = 0  # their share in quarters, rounded up
    head: str = ""
    name: str = ""  # key words and signs are known as they are
    key: bool = False

    @property
    def hard(self) -> bool:
        return self.length >= 2 and self.digits > 0

    @property
    def code(self) -> bool:
        return self.name in _CODE


EDGE = Make("edge")


def make_of(token: str) -> Make:
    n = len(token)
    if token.isalpha():
        low = token.lower()
        kind = "lower" if token == low else "upper" if token.isupper() else "title" if token[1:].islower() else "letters"
        return Make(kind, "a", min(n, 64) // 4, len(set(low)) // 2, 0, "", low if low in _KEYS else "", low in _KEYS)
    if n == 1 and not token.isalnum():
        return Make("sign", name=token)
    shape = []
    for c in token:
        k = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "9" if "0" <= c <= "9" else "-" if c in "+/_.-" else c if c.isascii() else "u"
        if not shape or shape[-1] != k:
            shape.append(k)
            if len(shape) == 8:
                break
    body = token.translate(_NO_SIGNS)
    if body.isalpha():
        kind = "joined"
    elif not token.isascii():
        kind = "other"
    elif body.isdigit() or not body:
        kind = "digits"
    else:
        kind = "hex" if _HEX_CHARS.issuperset(token) else "caps" if body.isupper() else "mixed"
    digits = sum(map(token.count, "0123456789"))
    head = token[:4] if token[:4].isalpha() and kind != "joined" else ""
    return Make(kind, "".join(shape), min(n, 64) // 4, len(set(token)) // 2, -(-4 * digits // n), head, "", not _KEYS.isdisjoint(_LETTERS.findall(token.lower())))


def own_features(m: Make) -> list[str]:
    """Shape and make of a token."""
    return ["bias", f"kind {m.kind}", f"shape {m.shape}", f"length {m.kind} {m.length}", f"distinct {m.kind} {m.distinct}", f"digits {m.digits} {m.length}", f"head {m.head} {m.kind}", f"key {m.key}"]


def context(m: Make) -> str:
    """How neighbours see a token: key words and signs as they are, others by their make."""
    return m.name or f"{m.kind} {min(m.length, 4)} {m.key}"


def role_slots(m: Make) -> list[list[int]]:
    """Feature slots of a token in each of its roles; the edge of a text has none of its own."""
    seen = context(m)
    return [[] if m is EDGE else _slots(f"own {x}" for x in own_features(m)), *([_slot(f"{r} {seen}")] for r in ROLES[1:])]


def file_features(n: int, hard: int, code: int) -> list[str]:
    """Of a text of n tokens, of which ``hard`` are long and hold a digit and ``code`` are signs of code."""
    return [f"file code {min(4, 16 * code // max(1, n))}", f"file size {n.bit_length() // 2}", f"file hard {min(8, hard.bit_length())}"]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % (DIM - 1) + 1


def _slots(features) -> list[int]:
    return [_slot(x) for x in features]


def place_slots(kind: str, key_near: bool, of_file: list[str]) -> list[int]:
    return _slots([f"near key {key_near} {kind}", *(f"{x} {kind}" for x in of_file)])


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What of the rules' spans is secret: values without their key words."""
    parts = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(s, e) for s, k, e in base_spans(text) if k]
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def observations(tokens: list[str], of_file: list[str]) -> list[list[int]]:
    """Feature slots of every token of a list, whose ends are edges."""
    makes = [make_of(t) for t in tokens]
    roles, edge = [role_slots(m) for m in makes], role_slots(EDGE)
    out = []
    for i, m in enumerate(makes):
        x = list(roles[i][0])
        for r, shift in enumerate(_SHIFTS[1:], 1):
            x += (roles[i - shift] if 0 <= i - shift < len(makes) else edge)[r]
        out.append(x + place_slots(m.kind, any(o.key for o in makes[max(0, i - 3) : i]), of_file))
    return out


def text_features(tokens: list[str]) -> list[str]:
    makes = [make_of(t) for t in tokens]
    return file_features(len(tokens), sum(m.hard for m in makes), sum(m.code for m in makes))


def training_windows(text: str, seed: int) -> list[tuple[list[list[int]], list[int]]]:
    """At most WINDOWS windows of a text: (observations, labels), between two edges without features.

    Around a secret, and the same secret once more amid other words of the
    text: labels come from rules that look at key words, and without this
    shapes would have nothing to explain. In texts without secrets around
    tokens that are no plain words, and one anywhere.
    """
    rng = random.Random(zlib.crc32(text.encode()) + seed)
    found = list(_TOKEN.finditer(text))
    if not found:
        return []
    tokens = [m[0] for m in found]
    labels = [OUTSIDE] * len(tokens)
    ends = [m.end() for m in found]
    spans = []
    for s, e in secret_parts(text):
        a = bisect.bisect_right(ends, s)
        b = a
        while b < len(found) and found[b].start() < e:
            labels[b] = BEGIN if b == a else INSIDE
            b += 1
        if b > a:
            spans.append((a, b))
    of_file = text_features(tokens)
    out = []

    def take(part: list[str], truth: list[int], skip_left: int, skip_right: int) -> None:
        x = observations(part, of_file)
        out.append(([[], *x[skip_left : len(x) - skip_right], []], [OUTSIDE, *truth[skip_left : len(truth) - skip_right], OUTSIDE]))

    def around(a: int, b: int) -> None:
        low, high = max(0, a - SIDE - 3), min(len(tokens), b + SIDE + 3)
        take(tokens[low:high], labels[low:high], min(3, max(0, a - SIDE - low)), min(3, max(0, high - b - SIDE)))

    if spans:
        for a, b in rng.sample(spans, min(WINDOWS // 2, len(spans))):
            b = min(b, a + 2 * SIDE)
            around(a, b)
            q = rng.randrange(len(tokens) + 1)
            left, right = slice(max(0, q - SIDE), q), slice(q, q + SIDE)
            if not any(labels[left]) and not any(labels[right]):
                take(tokens[left] + tokens[a:b] + tokens[right], labels[left] + labels[a:b] + labels[right], 0, 0)
    else:
        odd = [i for i, t in enumerate(tokens) if make_of(t).kind not in ("lower", "title", "sign")]
        for i in [*rng.sample(odd, min(WINDOWS - 1, len(odd))), rng.randrange(len(tokens))]:
            around(i, i + 1)
    return out


def _windows(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, has, draw in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for x, labels in training_windows(text.as_py(), seed):
                    rows.append((has, draw, len(rows), [v for o in x for v in o], list(map(len, x)), labels))
            if rows:
                kinds = [pa.bool_(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["has", "draw", "k", "slots", "sizes", "labels"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> ChainCrf | None:
    """Learn from the spans that the rules find in a bounded sample; None if they find none in any document.

    All documents are scanned, and those with a span and those without are
    sampled each for themselves by a hash, so rare secrets are learned from at
    any size. Of a sampled document at most WINDOWS windows come to the driver,
    as numbers, so what it gathers is bounded in bytes too. Equal rows that are
    sampled together beyond the bound are left out by their order.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    n = {r["has"]: r["count"] for r in rows.groupBy(has_span().alias("has")).count().collect()}
    if not n.get(True):
        return None
    span = 1 << 40
    of = {k: int(span * min(1.0, sample / max(1, n.get(k, 0)))) for k in (True, False)}
    drawn = rows.select("text", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("draw"))
    at = F.pmod("draw", F.lit(span))
    part = drawn.where(at < max(of.values())).select("text", has_span().alias("has"), "draw").where(at < F.when(F.col("has"), of[True]).otherwise(of[False]))
    taken = part.mapInArrow(_windows(seed), "has boolean, draw long, k long, slots array<int>, sizes array<int>, labels array<int>")
    taken = taken.groupBy("draw", "k").agg(*(F.min(c).alias(c) for c in ("slots", "sizes", "labels"))).orderBy("draw", "k").limit(3 * sample * WINDOWS).collect()
    indptr, indices, sequences, at = [0], [], [], 0
    for r in taken:
        indices += r["slots"]
        for size in r["sizes"]:
            indptr.append(indptr[-1] + size)
        sequences.append((np.arange(at, at + len(r["sizes"])), np.array(r["labels"])))
        at += len(r["sizes"])
    if not any(labels.any() for _, labels in sequences):
        return None
    return train(Features(np.array(indptr), np.array(indices)), sequences, 3, DIM, epochs=8, batch=64, seed=seed)


class Tagger:
    """Finds the field's spans in batches of texts; what is known of tokens is kept between batches."""

    #: Characters whose tokens are looked up together.
    BLOCK = 1 << 20

    def __init__(self, model: ChainCrf, margin: float = MARGIN, most: int = 300_000):
        self.weights, self.margin, self.most = model.weights, margin, most
        self.trans = model.trans.copy()
        self.trans[OUTSIDE, INSIDE] = -1e9
        self.near = np.array([[self._sum([_slot(f"near key {k} {kind}")]) for kind in TOKEN_KINDS] for k in (False, True)])
        self.of_file: dict[str, np.ndarray] = {}
        into, out = self.trans[OUTSIDE, BEGIN], self.trans[[BEGIN, INSIDE], OUTSIDE].max()
        stay, inner = self.trans[OUTSIDE, OUTSIDE], self.trans[1:, 1:].max()
        #: What a tagged token can gain by transitions, at most.
        self.slack = max(0.0, inner - stay) + max(0.0, into + out - 2 * stay)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # of tokens, the number of their make
        self.numbers: dict[Make, int] = {}
        self.facts: list[tuple] = []
        self._number(EDGE)
        self._settle()

    def _sum(self, slots: list[int]) -> np.ndarray:
        return self.weights[slots].sum(0) if slots else np.zeros(3)

    def _number(self, m: Make) -> int:
        k = self.numbers.setdefault(m, len(self.numbers))
        if k == len(self.facts):
            self.facts.append(([self._sum(x) for x in role_slots(m)], TOKEN_KINDS.index(m.kind), m.key, m.hard, m.code))
        return k

    def _settle(self) -> None:
        """Arrays of what is known of all makes so far."""
        roles, kind, key, hard, code = zip(*self.facts)
        self.roles = list(np.array(roles).transpose(1, 0, 2).copy())
        self.kind, self.key, self.hard, self.code = np.array(kind), np.array(key), np.array(hard, dtype=np.int64), np.array(code, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        """The numbers of the makes of all tokens of a text, then three edges."""
        out, at = [], 0
        while at < len(text):
            end = at + self.BLOCK
            while end < len(text) and not text[end].isspace():
                end += 1
            tokens = tokens_of(text[at:end])
            for t in set(tokens).difference(self.index):
                self.index[t] = self._number(make_of(t))
            out.append(np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
            at = end
        return np.concatenate([*out, np.zeros(3, np.int32)])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of outside, begin and inside of all tokens, each text's followed by three edges, which are outside; and where texts start."""
        if len(self.index) > self.most:
            self._forget()
        ids = [self._ids(t) for t in texts]
        if len(self.facts) > len(self.kind):
            self._settle()
        starts = np.cumsum([0] + [len(x) for x in ids])[:-1]
        x = np.concatenate(ids)
        emit = self.roles[0][x]
        for r, shift in enumerate(_SHIFTS[1:], 1):
            of = self.roles[r]
            if shift > 0:
                emit[shift:] += of[x[:-shift]]
                emit[:shift] += of[0]
            else:
                emit[:shift] += of[x[-shift:]]
        key, near = self.key[x], np.zeros(len(x), dtype=bool)
        for shift in (1, 2, 3):
            near[shift:] |= key[:-shift]
        kind = self.kind[x]
        emit += self.near[near.astype(np.int64), kind]
        n = np.diff(np.r_[starts, len(x)])
        tables = np.array([self._file(file_features(a - 3, b, c)) for a, b, c in zip(n.tolist(), np.add.reduceat(self.hard[x], starts).tolist(), np.add.reduceat(self.code[x], starts).tolist())])
        emit += tables[np.repeat(np.arange(len(n)), n), kind]
        emit[x == 0] = (0.0, -1e6, -1e6)
        return emit, starts

    def _file(self, features: list[str]) -> np.ndarray:
        name = "|".join(features)
        if name not in self.of_file:
            self.of_file[name] = np.array([self._sum(_slots(f"{x} {kind}" for x in features)) for kind in TOKEN_KINDS])
        return self.of_file[name]

    def tags(self, emit: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens (from, to) that one span covers, by Viterbi."""
        can = emit[:, 1:].max(1) - emit[:, 0] + self.slack
        total = np.r_[0.0, np.cumsum(can)]
        before = total[1:] - np.minimum.accumulate(total[:-1])  # the most that a run which ends here can gain
        after = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        live = np.flatnonzero(before + after - can > 0)
        out = []
        for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1) if len(live) else ():
            part = emit[run[0] : run[-1] + 1]
            tag = viterbi(part, self.trans, self.trans[OUTSIDE], self.trans[:, OUTSIDE])
            i = 0
            while i < len(tag):
                j = i + 1
                if tag[i] == BEGIN:
                    while j < len(tag) and tag[j] == INSIDE:
                        j += 1
                    out.append((int(run[0]) + i, int(run[0]) + j))
                i = j
        return out

    def _sure(self, emit: np.ndarray, a: int, b: int) -> bool:
        """Whether the span's tags are better than outside by the margin."""
        gain = emit[a, BEGIN] - emit[a, OUTSIDE] + (emit[a + 1 : b, INSIDE] - emit[a + 1 : b, OUTSIDE]).sum()
        last = BEGIN if b == a + 1 else INSIDE
        gain += self.trans[OUTSIDE, BEGIN] + self.trans[last, OUTSIDE] - (b - a + 1) * self.trans[OUTSIDE, OUTSIDE]
        if b > a + 1:
            gain += self.trans[BEGIN, INSIDE] + (b - a - 2) * self.trans[INSIDE, INSIDE]
        return gain > self.margin

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the spans of each text."""
        emit, starts = self.scores(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        by_text: dict[int, list[tuple[int, int]]] = {}
        for a, b in self.tags(emit):
            if self._sure(emit, a, b):
                k = int(np.searchsorted(starts, a, side="right")) - 1
                by_text.setdefault(k, []).append((a - int(starts[k]), b - int(starts[k])))
        for k, found in by_text.items():
            at = {i: m.span() for i, m in enumerate(_TOKEN.finditer(texts[k]))}
            out[k] = [(at[a][0], at[b - 1][1]) for a, b in found]
        return out


def secret_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text; a decoded span that meets a rule's span is that span's and adds nothing."""
    added = tagger.spans(texts) if tagger and texts else [[]] * len(texts)
    out = []
    for text, spans in zip(texts, added):
        base = base_spans(text)
        out.append(sorted(base + [(s, 3, e) for s, e in spans if not any(b[0] < e and s < b[2] for b in base)]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanner(model: ChainCrf | None, most: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model is not None else None
        ids: list = []
        texts: list[str] = []
        size = 0

        def scanned() -> pa.RecordBatch:
            rows = []
            for doc, spans in zip(ids, secret_spans(texts, tagger)):
                base = [x for x in spans if x[1] < 3]
                counts = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((doc, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1]) + 64
                if size >= most:
                    yield scanned()
                    ids, texts, size = [], [], 0
        if ids:
            yield scanned()

    return run


def scan(docs: DataFrame, model: ChainCrf | None) -> DataFrame:
    """(doc_id, text) -> the spans of every row: counts by rule, a digest of the rules' spans, and all spans.

    A null text is empty and has no span; equal rows get equal results; a null
    doc_id stays null; no rows give no rows; further columns are not read. A
    very long text is tokenised in blocks and decoded whole; it needs some 100
    bytes of memory a token. Without a model the spans are those of the rules.
    One pass without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_scanner(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
