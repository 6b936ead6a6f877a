"""Personal data: base rules, and a semi-Markov conditional random field that adds what the rules miss.

The field scores whole candidate segments: features look at the segment's digits, groups, separators, check sums and at the
characters beside it. Segments have at most ``MAX_TOKENS`` tokens; a dynamic program over token ends picks boundaries and
types of all segments of a region at once, against the score zero of leaving a token out. A region is a run of
space-separated chunks that each hold a digit or an at-sign, or nothing but signs such as '-' and '('; text outside regions can't
hold a candidate segment, so the program over regions equals the program over the whole text.

Weights maximise the conditional likelihood of labelled regions: a small hand-made table, and regions of a bounded sample of
documents labelled by the base rules.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is only tried from its first digit: later starts in it end the same way
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_SIGN = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"\s")
_OCTETS = re.compile(r"[0-9](?:\.[0-9]++){3}")
_BETWEEN = "()+-."

#: Labelled regions: (text, spans as text, kind). A region without spans is all outside.
LABELLED = (
    ("ann.lee@mail.example.com", (("ann.lee@mail.example.com", "email"),)),
    ("<bob42@example.org>,", (("bob42@example.org", "email"),)),
    ("user@localhost", ()),
    ("@handle", ()),
    ("10.20.30.40", (("10.20.30.40", "ip"),)),
    ("192.168.7.21:8080", (("192.168.7.21", "ip"),)),
    ("999.10.20.30.40", (("10.20.30.40", "ip"),)),
    ("300.1.2.3", ()),
    ("1.2.3", ()),
    ("2024.05.06", ()),
    ("3.14159", ()),
    ("4111 1111 1111 1111", (("4111 1111 1111 1111", "card"),)),
    ("5500-0000-0000-0004", (("5500-0000-0000-0004", "card"),)),
    ("340000000000009", (("340000000000009", "card"),)),
    ("3782 822463 10005", (("3782 822463 10005", "card"),)),
    ("12 4111 1111 1111 1111", (("4111 1111 1111 1111", "card"),)),
    ("4111 1111 1111 1112", ()),
    ("1234567890123456", ()),
    ("12345678901234567", ()),
    ("9876543210987", ()),
    ("+1 (555) 010-2030", (("+1 (555) 010-2030", "phone"),)),
    ("+49 30 1234567", (("+49 30 1234567", "phone"),)),
    ("(555) 010-2030", (("(555) 010-2030", "phone"),)),
    ("555-010-2030", (("555-010-2030", "phone"),)),
    ("(212) 555-0142,", (("(212) 555-0142", "phone"),)),
    ("555.010.2030", (("555.010.2030", "phone"),)),
    ("2024-05-06", ()),
    ("06.05.2024", ()),
    ("1999 2000 2001", ()),
    ("12 345 678", ()),
    ("1000-2000", ()),
    ("1,234,567.89", ()),
    ("12:34:56", ()),
    ("20240506", ()),
    ("5550102030", ()),
    ("123456789", ()),
    ("978-3-16-148410-0", ()),
    ("100 200 300 400", ()),
    ("7 8 9 10 11 12", ()),
    ("#12345678", ()),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules: by kind as listed, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append(("email", start, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x) < 256 or not x.strip("0") or len(x.lstrip("0")) < 4 and int(x.lstrip("0")) < 256 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of chunks with a digit or an at-sign, and of the signs before them that a segment may hold or start with, if they can
    hold a segment: seven digits, an at-sign or four numbers with dots. Single spaces lie between the chunks of a run."""
    out: list[list[int]] = []
    for m in _SIGN.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, m.end())
        b = space.start() if space else len(text)
        last = out[-1][1] if out else 0
        while a - 2 >= last and text[a - 1] == " " and text[a - 2] in _BETWEEN:
            a -= 1
            while a > last and text[a - 1] in _BETWEEN:
                a -= 1
        if out and a - last == 1 and text[last] == " ":
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if "@" in (part := text[a:b]) or sum(c in "0123456789" for c in part) >= 7 or _OCTETS.search(part)]


def _beside(c: str) -> str:
    return "edge" if not c or c.isspace() else "alnum" if c.isalnum() else c if c in ".-@/:+" else "mark"


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def segment_features(kind: str, part: str, left: str, right: str) -> list[str]:
    digits = "".join(c for c in part if c in "0123456789")
    groups = re.findall("[0-9]+", part)
    seps = "".join(sorted({c for c in part if c in " -."}))
    f = ["bias", f"left {_beside(left)}", f"right {_beside(right)}"]
    if kind == "email":
        local, _, domain = part.partition("@")
        labels = domain.split(".")
        f += [f"labels {min(len(labels), 4)}", f"last {'word' if labels[-1].isalpha() and len(labels[-1]) > 1 else 'other'}",
              f"empty {'' in labels or local[:1] in '.-' or local[-1:] in '.-' or '..' in part}", f"local {_bucket(len(local), (1, 3))}"]
    elif kind == "ip":
        f += [f"octets {all(int(g) < 256 for g in groups if len(g) < 10) and all(len(g) < 4 for g in groups)}",
              f"zeros {any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    elif kind == "card":
        f += [f"luhn {luhn(digits)}", f"digits {len(digits)}", f"lead {digits[0] in '3456'}", f"seps {seps}",
              f"even {len({len(g) for g in groups[:-1]}) <= 1}", f"groups {_bucket(len(groups), (2, 3, 4, 5, 6))}",
              f"luhn {luhn(digits)} lead {digits[0] in '3456'} groups {len(groups) in (1, 3, 4, 5)}"]
    else:
        shape = "-".join(str(len(g)) for g in groups)
        f += [f"plus {part[0] == '+'}", f"digits {_bucket(len(digits), (8, 9, 10, 12))}", f"seps {seps}", f"paren {part.count('(') == part.count(')') and '(' in part}",
              f"groups {min(len(groups), 6)}", f"short {all(len(g) <= 4 for g in groups)}", f"plain {shape in ('3-3-4', '3-4')}",
              f"loose {part.count('(') != part.count(')')}"]
    return [f"{kind} {x}" for x in f]


def candidates(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Token starts (and the end) of a region, and the segments (first token, token after, kind) that could be an entity."""
    cuts = [m.start() for m in _TOKEN.finditer(text, a, b)] + [b]
    kind_of = [text[x] for x in cuts[:-1]]
    found = []
    for i, c in enumerate(kind_of):
        if c.isspace() or not (c.isascii() and c.isalnum() or c in "+("):
            continue
        digits = dots = ats = others = groups = 0
        email, number = c.isascii() and c.isalnum(), c in "+(0123456789"
        for j in range(i, min(len(kind_of), i + MAX_TOKENS)):
            d = kind_of[j]
            if d in "0123456789":
                digits += cuts[j + 1] - cuts[j]
                groups += 1
            elif d == ".":
                dots += 1
            elif d == "@":
                ats += 1
            elif d in "+" and j > i or d not in "+ ()-" or d == " " and cuts[j + 1] - cuts[j] > 1:
                number = False
            else:
                others += 1
            number &= ats == 0
            email &= ats <= 1 and (d.isascii() and d.isalnum() or d in "@._%+-")
            if not (email or number):
                break
            if email and ats == 1 and d.isascii() and d.isalnum():
                found.append((i, j + 1, "email"))
            if number and d in "0123456789":
                if groups == 4 and dots == 3 and not others and c in "0123456789":
                    found.append((i, j + 1, "ip"))
                if 13 <= digits <= 19 and not dots and c in "0123456789" and not re.search("[()]", text[cuts[i]:cuts[j + 1]]):
                    found.append((i, j + 1, "card"))
                if 7 <= digits <= 15:
                    found.append((i, j + 1, "phone"))
    return cuts, found


class SemiCRF:
    """Weights of segment features; unknown features weigh nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def scored(self, text: str, a: int, b: int):
        cuts, segments = candidates(text, a, b)
        for i, j, kind in segments:
            f = segment_features(kind, text[cuts[i]:cuts[j]], text[cuts[i] - 1:cuts[i]] if cuts[i] else "", text[cuts[j]:cuts[j] + 1])
            yield cuts, i, j, kind, f

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best joint choice of segments of a region."""
        ends, cuts = defaultdict(list), [a, b]
        get = self.weights.get
        for cuts, i, j, kind, f in self.scored(text, a, b):
            s = sum(get(x, 0.0) for x in f)
            if s > 0:  # leaving its tokens out is never worse otherwise
                ends[j].append((i, s, kind))
        if not ends:
            return []
        n = len(cuts) - 1
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s, kind in ends.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, cuts[i], cuts[j]))
                j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, set[tuple[str, int, int]]]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-3) -> "SemiCRF":
        """Stochastic gradient ascent (AdaGrad) on the conditional log-likelihood; exact sums by forward and backward passes."""
        names: dict[str, int] = {}
        data = []
        for text, gold in examples:
            segs = [(i, j, [names.setdefault(x, len(names)) for x in f], (kind, cuts[i], cuts[j]) in gold) for cuts, i, j, kind, f in self.scored(text, 0, len(text))]
            if segs:
                data.append((max(s[1] for s in segs), segs))
        w, g2 = [0.0] * len(names), [1e-6] * len(names)
        for _ in range(epochs):
            for n, segs in data:
                scores = [sum(w[k] for k in f) for _, _, f, _ in segs]
                by_end, by_start = defaultdict(list), defaultdict(list)
                for k, (i, j, _, _) in enumerate(segs):
                    by_end[j].append(k)
                    by_start[i].append(k)
                fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    fwd[j] = _log_sum([fwd[j - 1], *(fwd[segs[k][0]] + scores[k] for k in by_end[j])])
                for i in range(n - 1, -1, -1):
                    bwd[i] = _log_sum([bwd[i + 1], *(bwd[segs[k][1]] + scores[k] for k in by_start[i])])
                grad: dict[int, float] = defaultdict(float)
                for k, (i, j, f, gold) in enumerate(segs):
                    d = gold - math.exp(min(0.0, fwd[i] + scores[k] + bwd[j] - fwd[n]))
                    if abs(d) > 1e-4:
                        for x in f:
                            grad[x] += d
                for x, d in grad.items():
                    d -= decay * w[x]
                    g2[x] += d * d
                    w[x] += rate * d / math.sqrt(g2[x])
        self.weights = {name: w[k] for name, k in names.items()}
        return self


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def labelled_examples() -> list[tuple[str, set]]:
    return [(text, {(kind, text.index(part), text.index(part) + len(part)) for part, kind in spans}) for text, spans in LABELLED]


def examples_from(texts: list[str], at_most: int) -> list[tuple[str, set]]:
    """Regions of texts, labelled by the base rules; those that share a shape count once."""
    out: dict[str, tuple[str, set]] = {}
    for text in texts:
        spans = base_spans(text)
        for a, b in regions(text):
            part = text[a:b]
            shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", part)) + str(sum(luhn(x) for x in re.findall("[0-9]{13,}", part)))
            if len(out) < at_most and shape not in out and len(part) < 400:
                out[shape] = (part, {(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b})
    return list(out.values())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 400, max_regions: int = 800) -> SemiCRF:
    """Fit on the labelled table and on regions of at most ``max_rows`` rows, those with the smallest id hashes
    among texts of under 20,000 characters (only the sample for training; ``find`` reads every text whole)."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("pii"))
    rows = docs.count()
    # about eight times as many ids have so small a hash: what reaches the driver doesn't grow with the table
    cut = -(1 << 63) + (1 << 64) * 8 * max_rows // max(rows, 8 * max_rows + 1)
    few = docs.where(h < F.lit(cut)) if rows > 8 * max_rows else docs
    some = few.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) < 20000)).orderBy(h, text_col).select(text_col).limit(max_rows)
    return SemiCRF().fit([*labelled_examples() * 4, *examples_from([r[0] for r in some.collect()], max_regions)])


def spans_of(text: str, model: SemiCRF) -> list[tuple[str, int, int, bool]]:
    """Base spans, and the field's segments that overlap none of them; by kind as listed, then start."""
    if not _SIGN.search(text):
        return []
    base = base_spans(text)
    starts, ends = zip(*sorted((s, e) for _, s, e in base), strict=True) if base else ((), ())
    furthest = [*accumulate(ends, max)]  # end of the spans up to each in order of start

    def free(s: int, e: int) -> bool:
        before = bisect_left(starts, e)
        return not before or furthest[before - 1] <= s

    out = [(k, s, e, True) for k, s, e in base]
    for a, b in regions(text):
        out += [(k, s, e, False) for k, s, e in model.decode(text, a, b) if free(s, e)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find(docs: DataFrame, model: SemiCRF, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: spans (kind, start, end, base) in code points, ends exclusive.

    A null or empty text has none. The whole text is read, however long. Repeated rows are read each on their own; an empty
    table gives no rows. A column called ``out`` is replaced, all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def spans(values: pa.Array) -> pa.Array:
        m = SemiCRF(shared.value)
        rows = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans_of(v.as_py(), m)] if v.is_valid else [] for v in values]
        return pa.array(rows, _SPANS)

    return docs.withColumn(out, F.arrow_udf(spans, SPANS)(F.col(text_col)))
