"""Secret scans: patterns of known secrets, and values in credential contexts that would take many guesses.

The base patterns find assignments, access keys and long hexadecimal runs. The method adds values that stand behind a
credential word and ``:``, ``=``, ``=>`` or ``:=`` (or behind ``bearer``) if their guess cost is high. The cost is the
minimum over all segmentations of the value into words, dates, repeats, keyboard walks and brute-force spans, each
costing the decimal logarithm of its guesses and ``STEP`` for its kind; it is found by dynamic programming over the
places of the value. Values like ``letmein123`` or ``changeme`` stay below ``LEAST`` and are not added.

Segments (case is ignored, then paid for): a word of ``WORDS``, also reversed or with look-alike digits and signs; a
run of 4 to 15 letters with a vowel in every five, as a word of no list; a date or year; the longest run of a repeated
unit of 1 to 8 characters; the longest walk of 3 or more over neighbouring keys; any span, character by character.

Defined cases: a null or empty text has no spans. Rows of one doc_id are scanned one by one; a null doc_id stays null.
An empty table gives an empty result. Other columns are ignored by the query and passed through by ``scan``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, documents, free_name

KINDS = ("assign", "access", "hex", "guess")
#: A value is added if it takes ten to this many guesses or more.
LEAST = 10.0
LEAST_CHARS = 8

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # on text with A-Z in lower case
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    rb"""(?:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|credentials?|(?:access|auth|client|encryption|private|signing)[_-]?(?:key|secret|token))|password|passwd|secret|token|api[_-]?key)"""
    rb"""["']?(?:[\x20\t]*(?:=>|:=|[:=])[\x20\t]*|(?<=token)[\x20\t]+bearer[\x20\t]+)["']?([!#-&(-+\x2d-:=?-~]{8,})""")

#: Frequent words of passwords, the most frequent first.
WORDS = """password qwerty admin welcome letmein monkey dragon master login iloveyou princess sunshine football baseball shadow
superman batman michael jordan charlie hunter killer pepper summer winter spring autumn secret token access private public
changeme change default example sample placeholder test testing tester temp temporary user username root guest demo system
server database service account manager office company project hello world love angel flower freedom whatever trust ninja
mustang computer internet google apple orange banana cookie cheese chocolate coffee magic silver golden purple yellow black
white green blue red star hockey soccer tennis guitar music tiger lion eagle ranger hammer thunder diamond happy lucky
please enter insert your here value string none null true false undefined redacted hidden masked empty todo key pass api
january february march april june july august september october november december monday friday sunday""".split()
_RANK = {w: i for i, w in reversed(list(enumerate(WORDS, 1)))}
#: Rows of keys, each half a key to the right of the one above.
KEYS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_PLACE = {c: (x + y / 2, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}
#: Signs that stand for letters.
ALIKE = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}

STEP = math.log10(5)
UNKNOWN_WORD = 6.5
YEARS = 200
_LENGTHS = sorted({len(w) for w in WORDS})
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
_DATES = [re.compile(p) for p in (
    r"(?=((?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<d>\d\d)))", r"(?=((?P<d>\d\d)(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<y>(?:19|20)\d\d)))",
    r"(?=((?P<m>\d\d)(?P<s>[-/._]?)(?P<d>\d\d)(?P=s)(?P<y>(?:19|20)\d\d)))")]
_LETTERS = re.compile("[a-z]+")
_NO_VOWEL = re.compile("[^aeiouy]{5}")

Segment = tuple[int, int, float]


def char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _case_cost(part: str) -> float:
    upper, letters = sum(map(str.isupper, part)), sum(map(str.isalpha, part))
    if not upper:
        return 0.0
    return math.log10(2) if upper == letters or (upper == 1 and part[0].isupper()) else math.log10(2) * min(upper, letters - upper)


def words_in(value: str) -> Iterator[Segment]:
    low = value.lower()
    plain = "".join(ALIKE.get(c, c) for c in low)
    for i in range(len(value)):
        for n in _LENGTHS:
            if i + n > len(value):
                break
            signs = sum(a != b for a, b in zip(low[i : i + n], plain[i : i + n]))
            for text, extra in ((low[i : i + n], 0), (plain[i : i + n], signs), (plain[i : i + n][::-1], signs + 1)):
                if text in _RANK:
                    yield i, i + n, math.log10(_RANK[text]) + extra * math.log10(2) + _case_cost(value[i : i + n])
    for run in _LETTERS.finditer(low):
        a, b = run.span()
        if 4 <= b - a <= 15 and not _NO_VOWEL.search(run[0]):
            yield a, b, UNKNOWN_WORD + _case_cost(value[a:b])


def dates_in(value: str) -> Iterator[Segment]:
    for m in _YEAR.finditer(value):
        yield m.start(), m.start() + 4, math.log10(YEARS)
    for form in _DATES:
        for m in form.finditer(value):
            if 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31:
                yield m.start(), m.start() + len(m[1]), math.log10(YEARS * 372 * (4 if m["s"] else 1))


def repeats_in(value: str) -> Iterator[Segment]:
    codes = np.frombuffer(value.encode("latin-1"), np.uint8)
    for unit in range(1, min(8, len(value) // 2) + 1):
        same = np.concatenate([[False], codes[unit:] == codes[:-unit], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # value[a : b + unit] has this period
            times = (b - a) // unit + 1
            if times >= 2 and unit * times >= 3:
                yield a, a + unit * times, guess_cost(value[a : a + unit], False) + math.log10(times)


def walks_in(value: str) -> Iterator[Segment]:
    places = [_PLACE.get(c) for c in value.lower()]
    a, way, turns = 0, None, 0
    for i in range(1, len(places) + 1):
        step = None
        if i < len(places) and places[i] and places[i - 1]:
            step = (places[i][0] - places[i - 1][0], places[i][1] - places[i - 1][1])
            step = step if step in ((1, 0), (-1, 0), (0.5, 1), (-0.5, 1), (0.5, -1), (-0.5, -1)) else None
        if step is None:
            if i - a >= 3:
                yield a, i, math.log10(len(_PLACE) * (i - a)) + turns * math.log10(6) + _case_cost(value[a:i])
            a, way, turns = i, None, 0
        else:
            turns += step != way
            way = step


def segments(value: str, repeats: bool = True) -> Iterator[Segment]:
    """(from, to, cost) of all that is not brute force."""
    yield from words_in(value)
    yield from dates_in(value)
    yield from walks_in(value)
    if repeats:
        yield from repeats_in(value)


def guess_cost(value: str, repeats: bool = True) -> float:
    """The decimal logarithm of the guesses for ``value`` (ASCII) by its cheapest segmentation; linear in its length."""
    into: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in segments(value, repeats):
        into.setdefault(b, []).append((a, cost))
    best, brute = [0.0], math.inf
    for i, c in enumerate(value):
        brute = min(brute, best[i] + STEP) + char_cost(c)
        best.append(min([brute, *(best[a] + STEP + cost for a, cost in into.get(i + 1, ()))]))
    return best[-1]


def spans_of(text: str, least: float = LEAST) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, cost) in code points, by start and kind; the cost is that of a guess only."""
    raw = text.encode("utf-8", "replace")
    low = raw.lower()  # A-Z only
    found = [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(low) if len(m[2]) >= LEAST_CHARS]
    found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(raw)]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(raw)]
    for m in _CONTEXT.finditer(low):
        cost = guess_cost(raw[m.start(1) : m.end(1)].decode("ascii"))
        if cost >= least:
            found.append((m.start(1), 3, m.end(1), cost))
    if found and len(raw) > len(text):  # bytes to code points
        before = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
        found = [(int(before[a]), kind, int(before[b]), cost) for a, kind, b, cost in found]
    return sorted(found, key=lambda s: s[:3])


_SPANS = "array<struct<kind: string, start: bigint, end: bigint, guesses: double>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))


def _spans(least: float):
    @F.arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "guesses": cost} for a, k, b, cost in spans_of(t.as_py() or "", least)] for t in texts], _KIND)
    return find


def scan(docs: DataFrame, least: float = LEAST, name: str = "secrets") -> DataFrame:
    """The documents with their spans (kind, start, end, decimal logarithm of the guesses); a clashing name gets an underscore in front."""
    return docs.withColumn(free_name(name, docs.columns), _spans(least)(body()))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counted = [of(k) for k in KINDS]
    base = named(F.filter("secrets", lambda s: s["kind"] != KINDS[-1]))
    return found.select("doc_id", *counted[:3], F.sha2(base, 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"), counted[3])


#: Positions and the segmentation are not for SQL; the query is tested against brute force.
ORACLE = None
