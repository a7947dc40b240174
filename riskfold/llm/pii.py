"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) give spans that always stay.  The
field reads the *islands* of a text that hold a digit, an ``@`` or a spelled
``(at)``, cuts them to atoms (digit runs, letter runs, single marks) and
scores whole candidate segments per kind with features of the whole span
(shape, digit count, ranges, mark set, neighbouring words; a card must pass
the checksum to be a candidate).  A dynamic
program over segments of at most ``MAX_ATOMS`` atoms chooses boundaries and
kinds jointly; an atom outside every segment scores zero, so islands decode
independently and the decode of a whole text is exact.  Its segments that
touch no base span and score above ``margin`` are added.

Weights come from a bounded sample: documents in a range of the id hash that
holds about ``SAMPLE_DOCS``, of each the first ``SAMPLE_PER_DOC`` islands of
under ``SAMPLE_CHARS`` characters, at most ``SAMPLE_ISLANDS`` distinct ones and
``SAMPLE_PLAIN`` without a base span; labelled by the base patterns, each with
altered copies (spelled or spaced variants keep their label, broken checksums
and out-of-range parts lose it).  Scoring has no such bounds: an island of any
length is read left to right within a horizon of ``MAX_ATOMS`` atoms, in time
in proportion to its length and some 30 bytes an atom.

Null or empty text: no spans.  A table without any island gives zero weights,
and so adds nothing.  Rows are independent: repeated rows and null ids are
kept; output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from riskfold.llm.common import add_columns, documents

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, REACH = 24, 24
#: Learning sample: documents, distinct islands; islands of a document, their characters, islands without a base span.
SAMPLE_DOCS, SAMPLE_ISLANDS = 6000, 240
SAMPLE_PER_DOC, SAMPLE_CHARS, SAMPLE_PLAIN = 32, 400, 50

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a failed start inside a digit run fails like the run's first digit: the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARRIER = re.compile(r"[0-9@]\S*")
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]\S*")
_DIGITS = frozenset("0123456789")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _byte_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-6:]) <= 255 for p in parts)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield "email", lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind as listed, then start."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _byte_parts(m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that may hold personal data, with the neighbouring
    words within ``REACH`` characters; disjoint and in order."""
    marks = [(m.start(), m.end()) for m in _CARRIER.finditer(text)]
    if "at)" in text or "at]" in text:
        marks = sorted(marks + [(m.start(), m.end()) for m in _SPELLED.finditer(text)])
    out: list[list[int]] = []
    for s, e in marks:
        lo, hi = max(0, s - REACH), min(len(text), e + REACH)
        while lo and s - lo < 4 * REACH and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and hi - e < 4 * REACH and not text[hi].isspace():
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


class Atoms:
    """Places of an island's atoms and running sums over them, 16 bytes an atom."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.cuts = array("i", (m.start() for m in _ATOM.finditer(text)))
        self.cuts.append(len(text))
        self.n = len(self.cuts) - 1
        self.digits, self.dots, self.ats = (array("i", [0]) for _ in range(3))
        for lo, hi in zip(self.cuts, islice(self.cuts, 1, None)):
            c = text[lo]
            self.digits.append(self.digits[-1] + (hi - lo if c in _DIGITS else 0))
            self.dots.append(self.dots[-1] + (c == "." or (c == "d" and text[lo:hi] == "dot")))
            self.ats.append(self.ats[-1] + (c == "@" or (c == "a" and text[lo:hi] == "at")))

    def segments(self, i: int) -> Iterator[tuple[int, str, list[str]]]:
        """(end, kind, features) of the candidate segments that start at atom
        ``i``; what grows with the segment is carried along."""
        text, cuts, n = self.text, self.cuts, self.n
        at = cuts[i]
        c0 = text[at]
        if not (c0.isalnum() or c0 in "+("):
            return
        starts_numeric, shape, marks, gaps, runs, longest = c0 in "0123456789+(", "", set(), 0, [], 0
        around = None
        for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
            lo, hi = cuts[j - 1], cuts[j]
            last = text[lo:hi]
            c, alone = last[0], last[-1].isalnum()
            if c in _DIGITS:
                shape += "0" * len(last)
                runs.append(last)
                longest = max(longest, len(last))
            elif alone and not c.isdecimal():
                shape += "a"
                marks.update(x for x in last if not x.isascii())
            else:
                shape += last
                marks.update(last)
                gaps += last.count(" ")
            if not alone:
                continue
            d = self.digits[j] - self.digits[i]
            if d > 24:
                break
            numeric, kinds = starts_numeric and c in _DIGITS, []
            if numeric:
                if 13 <= d <= 19 and c0 in _DIGITS and luhn("".join(runs)):
                    kinds.append("card")
                if 7 <= d <= 15:
                    kinds.append("phone")
                if 4 <= d <= 12 and self.dots[j] - self.dots[i] == 3:
                    kinds.append("ip")
            if self.ats[j] - self.ats[i] == 1 and self.dots[j] - self.dots[i] >= 1 and c0.isalnum() and not c.isdigit():
                kinds.append("email")
            if not kinds:
                continue
            if around is None:
                before = text[max(0, at - 12):at]
                words = before.split()
                around = (f"l{before[-1:] if not before[-1:].isalnum() else 'w'}", f"w{words[-1].lower() if words else ''}")
            after = text[hi:hi + 1]
            common = ["b", f"n{d}", f"m{''.join(sorted(marks))[:8]}", around[0], f"r{after if not after.isalnum() else 'w'}", f"g{min(gaps, 6)}", around[1], f"u{longest}"]
            for kind in kinds:
                f = [*common, f"s{shape if kind != 'email' else _email_shape(text[at:hi])}"]
                if kind == "ip":
                    f.append(f"range{_byte_parts(runs)}")
                elif kind == "phone":
                    f += [f"plus{c0 == '+'}", f"last{len(runs[-1])}"]
                else:
                    f += _name_features(text[at:hi], before, after, len(last))
                yield j, kind, [f"{kind}|{x}" for x in f]


def _email_shape(span: str) -> str:
    return re.sub(r"\w+", "w", re.sub(r"\b(at|dot)\b", r"<\1>", span))


def _name_features(span: str, before: str, after: str, last: int) -> list[str]:
    head, _, tail = span.partition("@") if "@" in span else span.partition("at")
    return [f"tld{min(last, 5)}", f"whole{not before[-1:].isalnum() and before[-1:] not in '._%+-' if before else True}",
            f"cut{after in '.-' and after != ''}", f"head{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+ ?[(\[]?', head))}", f"dots{tail.count('.') + tail.count('dot')}"]


class Island(Atoms):
    """Atoms of a (bounded) learning island and all its candidate segments by
    end, with their features."""

    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.by_end: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(self.n + 1)]
        for i in range(self.n):
            for j, kind, f in self.segments(i):
                self.by_end[j].append((i, kind, f))

    def scored(self, weights: dict[str, float]) -> list[list[tuple[int, str, float]]]:
        get = weights.get
        return [[(i, k, sum(get(x, 0.0) for x in f)) for i, k, f in at] for at in self.by_end]


def decode(island: Atoms, weights: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """Best segmentation: (kind, start, end, score) within the island.  A state
    is the kind of the segment that ends here (last place: no segment).  Atoms
    are read left to right; scores of the last ``MAX_ATOMS`` places and the
    segments that end within as many are all that is held, besides two bytes a
    state and place for the way back."""
    get, none, n = weights.get, len(KINDS), island.n
    trans = [[get(f"{a}>{b}", 0.0) for b in KINDS] for a in (*KINDS, "")]
    states, horizon = range(none + 1), MAX_ATOMS + 1
    best: list[list[float]] = [[-math.inf] * (none + 1) for _ in range(horizon)]
    best[0][none] = 0.0
    ends: list[list] = [[] for _ in range(horizon)]
    steps, froms = bytearray((n + 1) * (none + 1)), bytearray((n + 1) * (none + 1))
    for j in range(1, n + 1):
        for e, kind, f in island.segments(j - 1):
            ends[e % horizon].append((j - 1, KINDS.index(kind), sum([get(x, 0.0) for x in f])))
        before, row, place = best[(j - 1) % horizon], [-math.inf] * (none + 1), j * (none + 1)
        p = max(states, key=before.__getitem__)
        row[none] = before[p]
        steps[place + none], froms[place + none] = 1, p
        for i, k, s in ends[j % horizon]:
            source = best[i % horizon]
            for q in states:
                v = source[q] + s + trans[q][k]
                if v > row[k]:
                    row[k] = v
                    steps[place + k], froms[place + k] = j - i, q
        ends[j % horizon] = []
        best[j % horizon] = row
    out, j = [], n
    k = max(states, key=best[n % horizon].__getitem__)
    while j:
        i, q = j - steps[j * (none + 1) + k], froms[j * (none + 1) + k]
        if k != none:
            score = next(sum(get(x, 0.0) for x in f) for e, kind, f in island.segments(i) if e == j and kind == KINDS[k])
            out.append((KINDS[k], island.cuts[i], island.cuts[j], score))
        j, k = i, q
    return out[::-1]


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return -math.inf if top == -math.inf else float(top + np.log(np.exp(x - top).sum()))


def _gradient(island: Island, gold: list[Span], weights: dict[str, float]) -> dict[str, float]:
    """Observed less expected feature counts (forward and backward sums)."""
    scored, none = island.scored(weights), len(KINDS)
    trans = np.array([[weights.get(f"{a}>{b}", 0.0) for b in KINDS] for a in (*KINDS, "")])
    fore = np.full((island.n + 1, none + 1), -math.inf)
    fore[0, none] = 0.0
    for j in range(1, island.n + 1):
        fore[j, none] = _log_sum(fore[j - 1])
        for i, kind, s in scored[j]:
            k = KINDS.index(kind)
            fore[j, k] = np.logaddexp(fore[j, k], _log_sum(fore[i] + trans[:, k]) + s)
    aft = np.full((island.n + 1, none + 1), -math.inf)
    aft[island.n] = 0.0
    starts: dict[int, list] = defaultdict(list)
    for j, at in enumerate(scored):
        for (i, kind, s), (_, _, f) in zip(at, island.by_end[j]):
            starts[i].append((j, KINDS.index(kind), s, f))
    for i in range(island.n - 1, -1, -1):
        aft[i] = aft[i + 1, none]
        for j, k, s, _ in starts[i]:
            aft[i] = np.logaddexp(aft[i], trans[:, k] + s + aft[j, k])
    total, grad = aft[0, none], defaultdict(float)
    for i, at in starts.items():
        for j, k, s, f in at:
            p = np.exp(np.minimum(fore[i] + trans[:, k] + s + aft[j, k] - total, 0.0))
            for q in np.flatnonzero(p > 1e-9):
                grad[f"{(*KINDS, '')[q]}>{KINDS[k]}"] -= p[q]
            for x in f if p.sum() > 1e-9 else ():
                grad[x] -= p.sum()
    index = {c: a for a, c in enumerate(island.cuts)}
    last, end = "", 0
    for kind, s, e in sorted(gold, key=lambda g: g[1]):
        found = [f for i, k, f in island.by_end[index[e]] if k == kind and island.cuts[i] == s] if s in index and e in index else []
        for f in found[:1]:
            for x in f:
                grad[x] += 1.0
            grad[f"{last if end == s else ''}>{kind}"] += 1.0
            last, end = kind, e
    return grad


def variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The island itself, and copies with one span rewritten: spelled or
    respaced values keep their label, broken values lose it."""
    yield text, spans
    for n, (kind, s, e) in enumerate(spans):
        v = text[s:e]
        digits = re.sub("[^0-9]", "", v)
        if kind == "email":
            good = [v.replace("@", " (at) "), v.replace("@", "(at)").replace(".", " (dot) "), v.replace("@", " [at] ")]
            bad = [v.replace("@", " "), v.rpartition("@")[0] + "@"]
        elif kind == "ip":
            good = [v.replace(".", "[.]"), v.replace(".", " . ")]
            bad = [f"{300 + int(v[:1])}{v[v.find('.'):]}", ".".join(v.split(".")[:3])]
        elif kind == "card":
            cut = [digits[i:i + 4] for i in range(0, len(digits), 4)]
            good = [".".join(cut), "  ".join(cut), "/".join(cut)]
            bad = [digits[:-1] + str((int(digits[-1]) + 1 + n % 8) % 10), digits[:12]]
        else:
            tail = digits[-10:]
            good = [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{digits[:-10]} {tail[:3]} {tail[3:6]} {tail[6:]}"]
            bad = [tail[:7], f"20{tail[:2]}-{tail[2:4]}-{tail[4:6]}", f"{tail[:3]}{tail[3:]}"]
        for new, label in [*((g, True) for g in good), *((b, False) for b in bad)]:
            shift = len(new) - len(v)
            rest = [(k, a + shift * (a >= e), b + shift * (a >= e)) for m, (k, a, b) in enumerate(spans) if m != n and (b <= s or a >= e)]
            yield text[:s] + new + text[e:], sorted([*rest, *([(kind, s, s + len(new))] if label else [])], key=lambda x: x[1])


def fit(texts: list[str], epochs: int = 4, rate: float = 0.5, decay: float = 1e-4) -> dict[str, float]:
    """Weights by AdaGrad on the conditional likelihood; deterministic."""
    data = [(Island(t), g) for text in texts for t, g in variants(text, _disjoint(base_spans(text)))]
    weights: dict[str, float] = {}
    seen: dict[str, float] = defaultdict(float)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(data)):
            for x, g in _gradient(*data[at], weights).items():
                g -= decay * weights.get(x, 0.0)
                seen[x] += g * g
                weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(seen[x] + 1e-6)
    return weights


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda x: (x[1], -x[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_islands: int = SAMPLE_ISLANDS) -> dict[str, float]:
    """Weights from the islands of a bounded sample of ``docs``."""
    own = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("_t")).where("_i is not null")
    # ids' hashes spread evenly: the share of the range that holds about sample_docs documents
    reach = min(int(-2**63 + 2**64 * min(1.0, sample_docs / max(own.count(), 1))), 2**63 - 1)
    sample = own.where((F.xxhash64("_i") <= F.lit(reach)) & F.col("_t").rlike("[0-9@]"))
    field = StructField("_r", ArrayType(StringType()))

    def make():
        return lambda texts: [[[t[a:b] for a, b in islands(t)[:SAMPLE_PER_DOC] if b - a < SAMPLE_CHARS] for t in texts]]

    found = add_columns(sample, ["_t"], [field], make).select(F.explode("_r").alias("r")).distinct()
    rows = [r[0] for r in found.orderBy(F.xxhash64("r"), "r").limit(sample_islands).collect()]
    return fit([r for r in rows if base_spans(r)] + [r for r in rows if not base_spans(r)][:SAMPLE_PLAIN])


def all_spans(text: str, weights: dict[str, float], margin: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the field adds."""
    found = islands(text)
    if not found:
        return [], []
    base, added = base_spans(text), []
    covered = _merged([(s, e) for _, s, e in base])
    for lo, hi in found:
        for kind, s, e, score in decode(Atoms(text[lo:hi]), weights):
            if score > margin and not _touches(covered, lo + s, lo + e):
                added.append((kind, lo + s, lo + e))
    return base, added


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _touches(covered: list[tuple[int, int]], s: int, e: int) -> bool:
    from bisect import bisect_left
    i = bisect_left(covered, (e, -1))
    return i > 0 and covered[i - 1][1] > s


FIELDS = [
    StructField("base_spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("added_spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))),
]


def find(docs: DataFrame, weights: dict[str, float], text: str = "text", margin: float = 2.0) -> DataFrame:
    """``docs`` plus ``base_spans`` and ``added_spans`` (kind, start, end in
    code points, end exclusive), each by kind as listed, then start."""

    def make():
        def work(texts: list) -> list:
            both = [all_spans(t or "", weights, margin) for t in texts]
            named = [[[{"kind": k, "start": s, "end": e} for k, s, e in sorted(x, key=lambda y: (KINDS.index(y[0]), y[1]))] for x in side] for side in zip(*both)]
            return named or [[], []]
        return work

    return add_columns(docs, [text], FIELDS, make)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query, from the spans of ``find``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def of_kind(kind):
        return F.array_sort(F.filter(F.concat("base_spans", "added_spans"), lambda s: s["kind"] == kind))

    ordered = F.flatten(F.array(*[of_kind(k) for k in KINDS]))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
                        joined(ordered).alias("spans"), F.size("added_spans").cast(LongType()).alias("n_added"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(find(docs, train(docs)))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()
