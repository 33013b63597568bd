"""Secret scans: fixed patterns, and a guess-cost estimate for values in a credential context.

A value that follows a credential's name is cut into words, dates, repeats,
keyboard walks and brute-force spans such that the guesses an attacker needs
are fewest (a shortest path over the value's characters). Values that take
``10 ** LEAST_COST`` guesses or more are reported as ``guess`` spans, besides
the spans of the fixed patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.arrow import OUT, annotated
from gneiss.llm.common import most_frequent, stored, table
from gneiss.llm.language import word_counts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is maximal either way
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
_NAME = r"""(?:passwords?|passwd|passphrase|pwd|secret|token|credentials?|(?:api|access|private|signing)[_-]?key|authorization|bearer)["']?[\x20\t]*(?:=>|:=|[:=])"""
#: A name and its value; a scheme word as in a header stands before the value, unless a name with a value of its own follows.
CONTEXT = re.compile(_NAME + rf"""[\x20\t]*["']?(?:(?:bearer|basic|token)[\x20\t]+(?!{_NAME})["']?)?([^\s"'<>,;]{{6,}})""", re.ASCII | re.IGNORECASE)
#: Lower-cased texts without any of these have no match of ASSIGN or CONTEXT.
NAMES = ("passw", "passphrase", "pwd", "secret", "token", "credential", "key", "authorization", "bearer")

#: Guesses, as powers of ten, from which a value counts as a secret; words of the corpus that a guesser tries.
LEAST_COST, WORDS = 10.0, 20_000
#: What people choose most, in this order. Fixed values of this operator.
COMMON = "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow superman secret changeme default guest root test user example sample demo null none true false token key value string redacted placeholder hidden undefined".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?', "`1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./")
_LOOKALIKES = str.maketrans("430157@$!", "aeoistasi")
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")


def word_lengths(order: dict[str, int]) -> tuple[int, ...]:
    return tuple(sorted({len(x) for x in order if len(x) >= LEAST_WORD}))


def _neighbours() -> dict[str, str]:
    """Keys next to a key; each row stands half a key to the right of the one above."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {c: "".join(d for d, q in place.items() if d != c and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1) for c, p in place.items()}


NEAR = _neighbours()


def ranks(words: list[str]) -> dict[str, int]:
    """Guessing order: the common choices, then the corpus's words by frequency."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


CUT, STEP = math.log10(2), math.log10(1.5)
UNITS = (1, 2, 3, 4)
LEAST_WORD, LEAST_WALK, LEAST_REPEAT = 3, 3, 3


def date_cost(size: int) -> float:
    return math.log10(366 * 120 if size > 4 else 120)


def walk_cost(size: int) -> float:
    return math.log10(len(NEAR)) + STEP * (size - 1)


def repeat_cost(unit: int, times: int) -> float:
    return unit + math.log10(times)


def word_cost(part: str, rank: int, looks: bool) -> float:
    case = 0.0 if part == part.lower() else math.log10(2) if part in (part.upper(), part.capitalize()) else len(part) * math.log10(2)
    return math.log10(rank) + (math.log10(4) if looks else 0.0) + case


class _Repeats:
    """The cheapest start of a repeat of one unit that ends here, among starts of one residue.

    Starts i cost best[i] + log10((j - i) / unit) at j. Of two starts the later
    one is cheaper first, and the earlier one for good from a point on; the
    stack has the starts in that order, each until the one below overtakes it.
    """

    def __init__(self, best: list[float]):
        self.best, self.stack = best, []

    def _overtakes(self, a: int, b: int) -> float:
        """From where on the earlier start a is as cheap as b."""
        ratio = 10 ** (self.best[b] - self.best[a])
        return (ratio * b - a) / (ratio - 1) if ratio > 1 else math.inf

    def add(self, i: int) -> None:
        stack, best = self.stack, self.best
        while stack and best[stack[-1]] >= best[i]:
            stack.pop()
        while len(stack) > 1 and self._overtakes(stack[-2], stack[-1]) <= self._overtakes(stack[-1], i):
            stack.pop()
        stack.append(i)

    def start(self, j: int) -> int:
        while len(self.stack) > 1 and self._overtakes(self.stack[-2], self.stack[-1]) <= j:
            self.stack.pop()
        return self.stack[-1]


def guess_cost(value: str, order: dict[str, int], lengths: tuple[int, ...] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the fewest guesses for value over all its segmentations, and the segments (kind, start, end) of one that gives it.

    One pass over the ends of segments. ``best[j]`` is the cost of the first j
    characters. The costs of brute-force spans and keyboard walks grow by a
    constant with each character, so that of all open ones the cheapest stays
    the cheapest; repeats keep a stack of starts; words and dates are jumps.
    Time is proportional to the length, times the number of word lengths
    (those of order, if not given). Each segment doubles the guesses.
    """
    n, low, plain = len(value), value.lower(), value.translate(_SHIFTED).lower()
    if len(low) != n:  # lower case of another length
        low = plain = value
    looks = low.translate(_LOOKALIKES)
    if lengths is None:
        lengths = word_lengths(order)
    best: list[float] = [0.0] + [math.inf] * n
    came: list[tuple[str, int]] = [("", 0)] * (n + 1)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if cost + CUT < best[j]:
            best[j], came[j] = cost + CUT, (kind, i)

    dates: dict[int, list[int]] = {}
    for pattern in (_DATE, _YEAR):
        for m in pattern.finditer(value):
            dates.setdefault(m.end(1), []).append(m.start(1))
    brute, brute_from, walk, walk_from, chain = math.inf, 0, math.inf, 0, 0
    runs = dict.fromkeys(UNITS, 0)
    repeats = {unit: [_Repeats(best) for _ in range(unit)] for unit in UNITS}
    for j in range(1, n + 1):
        brute, brute_from = min((brute + 1, brute_from), (best[j - 1] + 1, j - 1))
        offer("brute", brute_from, j, brute)
        # Steps from key to key that end here without a break.
        chain = chain + 1 if j > 1 and plain[j - 1] in NEAR.get(plain[j - 2], "") else 0
        if chain < LEAST_WALK - 1:
            walk = math.inf
        else:
            i = j - LEAST_WALK
            walk, walk_from = min((walk + STEP, walk_from), (best[i] + walk_cost(LEAST_WALK), i))
            offer("walk", walk_from, j, walk)
        for size in lengths:
            if size > j:
                break
            i = j - size
            if rank := order.get(low[i:j]):
                offer("word", i, j, best[i] + word_cost(value[i:j], rank, False))
            if rank := order.get(looks[i:j]):
                offer("word", i, j, best[i] + word_cost(value[i:j], rank, True))
        for i in dates.get(j, ()):
            offer("date", i, j, best[i] + date_cost(j - i))
        for unit in UNITS:
            if j > unit and value[j - 1] == value[j - 1 - unit]:
                runs[unit] += 1
            else:
                runs[unit] = 0
                for x in repeats[unit]:
                    x.stack.clear()
            times = max(2, -(-LEAST_REPEAT // unit))
            if runs[unit] >= unit * (times - 1):
                own = repeats[unit][j % unit]
                own.add(j - unit * times)
                i = own.start(j)
                offer("repeat", i, j, best[i] + repeat_cost(unit, (j - i) // unit))
    segments, j = [], n
    while j:
        kind, i = came[j]
        segments.append((kind, i, j))
        j = i
    return best[n], segments[::-1]


def scan(text: str | None, order: dict[str, int], least_cost: float = LEAST_COST, lengths: tuple[int, ...] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed, then end. Null is the empty text."""
    if not text:
        return []
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        found += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], order, lengths)[0] >= least_cost]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secrets(docs: DataFrame, keep: list[str], words: int = WORDS, least_cost: float = LEAST_COST) -> DataFrame:
    """The columns keep of docs and a struct OUT with the array spans (kind, start, end).

    The guesser's word list is the corpus's own: its most frequent words, of
    which there are at most ``words``. A null text is empty and has no spans;
    repeated rows are scanned each for itself, and count in the word list as
    often as they occur; words of equal counts are ranked by code point. Texts
    and values of any length are scanned whole. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    counts = word_counts(docs.select("text", F.lit("").alias("lang")))
    known = stored(counts.where(f"n > 1 and length(word) >= {LEAST_WORD}"), "words")
    frequent = most_frequent(known, words).collect()  # of a bounded size
    order = spark.sparkContext.broadcast(ranks([x.word for x in sorted(frequent, key=lambda x: (-x.n, x.word))]))

    def start() -> Callable:
        known = order.value
        lengths = word_lengths(known)
        return lambda texts: ((scan(x, known, least_cost, lengths),) for x in texts)

    return annotated(docs, keep, "text", "spans array<struct<kind:string,start:int,end:int>>", start)


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets of documents: nulls, ties, repeats, long texts and empty tables as stated there."""
    found = secrets(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.col(f"{OUT}.spans").alias("spans"))
    number = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind != "guess")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
