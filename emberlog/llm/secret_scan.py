"""Secret scans: fixed patterns, and guess-cost dynamic programming over values in a credential's context.

The guess cost of a value is the least sum of log10 guesses over its segmentations into words, separators, dates, repeats,
keyboard walks and brute-force spans. Words come from words.txt, ranked, in en, de, fr and es. Walks are tried from
every start to every end, repeats too but for ends trimmed by more than TRIM characters. A value next to a credential word
counts as a secret where that cost reaches ``min_log10``; placeholders, listed words and most pairs of frequent words stay
below. An unlisted long word or a chain of several words does not. Found spans are added to those of the base patterns
unless one of these already covers them.

Defined results: null texts are empty and have no spans; whole texts and whole values are read; a value's time is linear
in its length (segments other than repeats and brute force are short); repeated rows are scanned each for itself.
"""
from __future__ import annotations

import math
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, by_slices

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]{14,}"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "guess")
#: A credential word starts a word (or a part in camel case); only unmistakable ones may end a compound ("accesstoken", "dbpass").
START = r"(?:(?<![a-zà-öø-ÿ])|(?-i:(?<=[a-zà-öø-ÿ])(?=[A-Z])))"
CONTEXT = re.compile(rf"""(?:{START}(?:(?:db|my|sql|user|admin|root|web|mail|ftp|smtp|ldap|wifi|key|store|sys)?pass(?:code)?|auth|bearer|pin)|pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key)["']?[\x20\t]{{0,4}}(?:[:=]|=>|\bis\b)[\x20\t]{{0,4}}["']?(?:bearer\x20)?([^\s"'<>`,;]{{6,}})""", re.I | re.A)

#: An assignment inside a value: the value proper comes after it.
NESTED = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth|credentials?)["']?[:=]["']?""", re.I | re.A)

#: Words that guessers try first, before those of words.txt.
WORDS = tuple("""password passwd pass secret token key api admin root user login test guest welcome monkey dragon master
letmein shadow sunshine princess football baseball superman batman trustno hello freedom whatever love money summer winter
spring autumn january february march april june july august september october november december monday tuesday wednesday
thursday friday saturday sunday example changeme default sample dummy placeholder redacted none null true false undefined
your here value string change this enter my the and for with not required required optional none todo company server
database access private public auth bearer basic""".split())
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
#: Guesses for a brute-force character, by its class.
BRUTE = {"digit": 10, "lower": 26, "upper": 26, "other": 33}
#: log10 of the cost of starting another segment.
JOIN = 0.6
#: What stands between words, and log10 of its guesses.
SEPARATORS, SEPARATOR = "-_./+", math.log10(5)
#: Repeats lose at most so many characters at each end to other segments.
TRIM = 16


@lru_cache(maxsize=4)
def ranked(words: tuple[str, ...] | None = None) -> tuple[dict[str, float], int]:
    """log10 of the guesses of each word, and the longest's length; of WORDS and the file's words where none are given."""
    if words is None:
        lines = Path(__file__).with_name("words.txt").read_text(encoding="utf-8").splitlines()
        words = tuple(dict.fromkeys([*WORDS, *(x for x in lines if not x.startswith("#"))]))
    return {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}, max(map(len, words), default=0)


def walk_starts(low: str) -> list[int]:
    """For each end, the least start of a keyboard walk or a sequence that reaches it; every later start is one too."""
    starts, first, step, turned = [0] * (len(low) + 1), 0, 0, 0
    for j in range(1, len(low)):
        a, b = low[j - 1], low[j]
        d = ord(b) - ord(a)
        near, follows = _adjacent(a, b), abs(d) == 1 and a.isalnum() and b.isalnum()
        if not near and not follows:
            first, step = j, 0
        elif not near and step not in (0, d):
            first = turned  # after the last step the other way
        if abs(d) == 1 and first < j:
            step, turned = d, j
        starts[j + 1] = first
    return starts


def begin() -> None:
    at_work("secret_scan", ranked.cache_clear)


def _adjacent(a: str, b: str) -> bool:
    return any(abs(i - j) == 1 for r in ROWS if (i := r.find(a)) >= 0 and (j := r.find(b)) >= 0)


def guess_cost(value: str, words: tuple[str, ...] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    (rank, longest), n, low = ranked(words), len(value), value.lower()
    if len(low) != n:  # some capitals have two characters in lower case
        low = "".join(x if len(x) == 1 else c for c in value for x in [c.lower()])
    plain = low.translate(LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: start, cost

    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            if (cost := rank.get(plain[i:j])) is not None:
                ends[j].append((i, cost + 0.3 * (value[i:j] != low[i:j]) + 0.5 * (plain[i:j] != low[i:j])))
        if m := DATE.match(value, i):
            ends[m.end()].append((i, math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)))
        if value[i] in SEPARATORS and 0 < i < n - 1:
            ends[i + 1].append((i, SEPARATOR))
    for size in (1, 2, 3, 4):  # repeats of a unit: runs where each character equals the one a unit before
        i = 0
        while i + size < n:
            j = i + size
            while j < n and low[j] == low[j - size]:
                j += 1
            for b in range(max(i, j - TRIM), j + 1):
                for a in range(i, min(i + TRIM, b - max(3, 2 * size)) + 1):
                    ends[b].append((a, size * math.log10(36) + math.log10((b - a) / size)))
            i = max(i + 1, j - size + 1)
    starts = walk_starts(low)
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)  # brute: the last character is in a brute-force span
    walk, first = math.inf, -1  # the cheapest start of a walk up to here, less what its characters will cost
    for j in range(1, n + 1):
        c = value[j - 1]
        each = math.log10(BRUTE["digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other"])
        brute[j] = min(brute[j - 1], best[j - 1] + JOIN * (j > 1)) + each
        best[j] = min([brute[j], *(best[i] + cost + JOIN * (i > 0) for i, cost in ends[j])])
        if j - starts[j] >= 3:
            old, first = first, starts[j]
            for a in range(first, j - 2) if old != first else (j - 3,):
                walk = min(walk if a > first else math.inf, best[a] + JOIN * (a > 0) - 0.35 * a)
            best[j] = min(best[j], walk + math.log10(40) + 0.35 * j)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, pattern, group, least in BASE:
        found += [(*m.span(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def guess_spans(text: str, base: list[tuple[int, int, str]], min_log10: float, words: tuple[str, ...] | None = None) -> list[tuple[int, int, str]]:
    """Values in a credential's context whose guess cost reaches the limit and that no base span covers."""
    found = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while n := NESTED.match(text, a, b):
            a = n.end()
        while b > a and text[b - 1] in ".!?)]}:":
            b -= 1
        if b - a >= 6 and not any(x <= a and b <= y for x, y, _ in base) and guess_cost(text[a:b], words) >= min_log10:
            found.append((a, b, "guess"))
    return found


def spans(text: str, min_log10: float = 9.0, words: tuple[str, ...] | None = None) -> tuple[list, list]:
    """Base spans, and all spans; each (start, end, kind), by start and kind."""
    base = base_spans(text)
    return base, sorted(base + guess_spans(text, base, min_log10, words), key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 9.0, words: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id and spans: an array of struct<start, stop, kind> (code points), by start, then kind as in KINDS."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        begin()
        found = [spans(text or "", min_log10, words)[1] for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "spans": [[{"start": a, "stop": b, "kind": k} for a, b, k in x] for x in found]}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_slices(run, SPANS), "doc_id long, spans array<struct<start:int,stop:int,kind:string>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", min_log10: float = 9.0, words: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with the value of every span replaced by a mark (of an assignment, only its value); columns as before."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        _, every = spans(text, min_log10, words)
        cut = []
        for a, b, kind in every:
            if kind == "assign":
                a = BASE[0][1].match(text, a).start(2)
            if cut and a <= cut[-1][1]:
                cut[-1][1] = max(cut[-1][1], b)
            else:
                cut.append([a, b])
        parts, at = [], 0
        for a, b in cut:
            parts += [text[at:a], mark]
            at = b
        return "".join(parts) + text[at:]

    def run(batches):
        begin()
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.set_column(i, batch.schema.field(i), pa.array([clean(x) for x in part.column(i).to_pylist()], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
