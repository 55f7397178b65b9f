"""Personal data: fixed patterns, and spans that a trained character tagger adds.

Every text is covered by overlapping windows, and every window is decoded by a bidirectional LSTM with CRF
transitions; the windows' spans are reconciled over the whole text: spans of a kind that overlap between windows are
one, then the set of spans that don't overlap and weigh most is kept (by the tagger's margins). Added spans must
have the form of their kind, and never touch a span of the patterns.

Defined cases: a null text is empty and has no spans; repeated rows get equal results; a null doc_id stays
null; an empty table gives no rows; other columns are ignored by `find` and kept by `mask`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .kernel import slices
from .tagger import KINDS, Tagger, classes, trained

WIDTH, STEP = 512, 464
Span = tuple[int, int, int]  # start, kind, end

# The patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_RUN_END, _RUN_START = re.compile(r"(?:[0-9][\x20-]?)*\Z"), re.compile(r"(?:[\x20-]?[0-9])*")
_TRIGGER = re.compile(r"[0-9@]")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)++")
#: The forms that spans added by the tagger must have.
_FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]([\x20-]?[0-9]){11,18}"),
    re.compile(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"),
)

#: By how much the ends of a tagged span may be off, the least first.
_SHIFTS = sorted(((i, j) for i in range(-2, 3) for j in range(-2, 3)), key=lambda x: (abs(x[0]) + abs(x[1]), x))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from their @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            lower = max(done, start - 256)
            run = _LOCAL_END.search(text[lower:start]).start() + lower
            full, start = run == lower, run
            if not full:
                break
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four numbers between dots: in a run of such numbers every four from the left are one match, so each
    run is read once."""
    for run in _NUMBERS.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _TRIGGER.search(text):
        out += [(a, 1, b) for a, b in _ips(text)] if "." in text else []
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def window_starts(length: int) -> range:
    """Starts of the windows that cover a text: neighbours share WIDTH - STEP characters."""
    return range(0, max(1, length - (WIDTH - STEP)), STEP) if length else range(0)


def window_spans(model: Tagger, codes: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """start, end, kind, weight of the spans of each window (in its own positions)."""
    out: list[list] = [[] for _ in codes]
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))  # windows of like length together
    for i in range(0, len(codes), 1024):
        here = order[i : i + 1024]
        part = [codes[j] for j in here]
        x = np.full((len(part), max(map(len, part))), 9, np.uint8)
        for j, c in enumerate(part):
            x[j, : len(c)] = c
        tags, margin = model.decode(np.ascontiguousarray(x.T))
        tagged = tags.any(0)
        for j, c in enumerate(part):
            if not tagged[j]:
                continue
            t, m, spans, at = tags[: len(c), j], margin[: len(c), j], out[here[j]], 0
            while at < len(t):
                if t[at] == 0:
                    at += 1
                    continue
                kind, end = (int(t[at]) - 1) // 2, at + 1
                while end < len(t) and t[end] == 2 * kind + 2:
                    end += 1
                spans.append((at, end, kind, float(m[at:end].sum())))
                at = end
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """One set for the whole text: start, end, kind. Overlapping spans of a kind are merged, then the heaviest set
    of spans that don't overlap is chosen (weighted interval scheduling)."""
    merged: list[list] = []
    for kind in range(len(KINDS)):
        last = None
        for s, e, _, w in sorted(x for x in spans if x[2] == kind):
            if last and s < last[1]:
                last[1], last[3] = max(last[1], e), max(last[3], w)
            else:
                merged.append(last := [s, e, kind, w])
    merged.sort(key=lambda x: x[1])
    ends, best, take = [x[1] for x in merged], [0.0], []
    for i, (s, _, _, w) in enumerate(merged):
        before = bisect_right(ends, s, 0, i)
        take.append(best[before] + w > best[i])
        best.append(max(best[i], best[before] + w))
    out, i = [], len(merged)
    while i:
        if take[i - 1]:
            s, e, k, _ = merged[i - 1]
            out.append((s, e, k))
            i = bisect_right(ends, s, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def _valid(text: str, a: int, b: int, kind: int) -> bool:
    """Whether text[a:b], which has its kind's form, stands alone and holds what its kind must."""
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    return not (kind == 1 and max(map(int, text[a:b].split("."))) > 255 or kind == 2 and not luhn(_digits(text[a:b])) or kind == 3 and not 9 <= len(_digits(text[a:b])) <= 15)


def _sound(text: str, s: int, e: int, kind: int) -> tuple[int, int] | None:
    """The part of a tagged span that has its kind's form, if it stands alone: what is found around the span, else the
    span itself, else the span with its ends moved a little. (What is found may run into a neighbour across a blank.)"""
    form = _FORMS[kind]
    m = form.search(text, max(0, s - 2), min(len(text), e + 2))
    if m and m.end() > s and m.start() < e and _valid(text, *m.span(), kind):
        return m.span()
    for a, b in ((s + i, e + j) for i, j in _SHIFTS):
        if 0 <= a < b <= len(text) and form.fullmatch(text, a, b) and _valid(text, a, b, kind):
            return a, b
    return None


def _cards(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The numbers in a tagged span that runs over several cards parted by blanks: of all ways to cut its groups of
    digits, one whose valid numbers hold the most digits."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", text[max(0, s - 2) : e + 2])]
    at, n = max(0, s - 2), len(groups)
    best: list[tuple[int, list]] = [(0, [])] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        for j in range(i + 1, min(n, i + 19) + 1):
            a, b = at + groups[i][0], at + groups[j - 1][1]
            if b - a > 37:
                break
            if _FORMS[2].fullmatch(text, a, b) and _valid(text, a, b, 2) and (size := len(_digits(text[a:b])) + best[j][0]) > best[i][0]:
                best[i] = size, [(a, b), *best[j][1]]
    return best[0][1]


def _parts(text: str, s: int, e: int, kind: int) -> list[tuple[int, int]]:
    """What a tagged span adds: its sound part; of a card also the valid numbers beside it in one run of digits."""
    ok = _sound(text, s, e, kind)
    if kind != 2:
        return [ok] if ok else []
    a, b = ok or (s, e)
    a -= len(_RUN_END.search(text[max(0, a - 80) : a])[0])
    b += len(_RUN_START.match(text[b : b + 80])[0])
    return ([ok] if ok else []) + _cards(text, a, b)


def all_spans(texts: list[str | None], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base, base and added) of each text."""
    base = [base_spans(t or "") for t in texts]
    places, codes = [], []
    for i, t in enumerate(texts):
        every = classes(t) if t else ()
        for s in window_starts(len(every)):
            places.append((i, s))
            codes.append(every[s : s + WIDTH])
    found: dict[int, list] = {}
    for (i, s), spans in zip(places, window_spans(model, codes), strict=True):
        found.setdefault(i, []).extend((a + s, b + s, k, w) for a, b, k, w in spans)
    out = []
    for i, b in enumerate(base):
        taken = [(x[0], x[2]) for x in b]
        added = []
        for s, e, kind in reconcile(found.get(i, [])):
            for ok in _parts(texts[i], s, e, kind):
                if not any(ok[0] < y and x < ok[1] for x, y in taken):
                    added.append((ok[0], kind, ok[1]))
                    taken.append(ok)
        out.append((b, sorted(b + added)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (of overlapping ones, their union) replaced by the kind of its first in brackets."""
    if not spans:
        return text
    out, at, runs = [], 0, []
    for s, k, e in spans:
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([s, k, e])
    for s, k, e in runs:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    model = trained()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 256)):
            found = all_spans(b.column(1).to_pylist(), model)
            columns = [b.column(0), *(pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))),
                       pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([written(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """docs with the spans in text masked (and n_chars, where there is one, counted anew)."""
    model = trained()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 256)):
            texts = b.column(at).to_pylist()
            out = [masked(t, every) for t, (_, every) in zip(texts, all_spans(texts, model), strict=True)]
            yield b.set_column(at, "text", pa.array(out, b.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
