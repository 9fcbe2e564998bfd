"""Secret scans by SQL functions only: fixed patterns, and the entropy of windows that slide over candidate strings.

* ``assign``, ``access`` and ``hex`` are places of fixed patterns.
* A candidate string is a run of 20 to 4 096 letters, digits, ``+``, ``/``, ``_`` and ``-`` (a longer run is cut into strings of 4 096, judged
  one by one) with a letter and a digit. For each character class a window slides over it; entering and leaving characters change the
  count of one character each and the sum of n * log2(n) by one difference, so that a step costs the same whatever the window's width. A
  window is hot if all its characters belong to the class, two or more are digits and two or more are not, and its Shannon entropy reaches
  the class's least. Hot windows that touch or overlap are one span.
* Candidates that match a pattern of the allow-list (ids in UUID form, alphabets written out, examples, digests with their name in front) have no
  such spans; the fixed patterns are not suppressed.

Sums are kept in millionths of a bit, as integers, so that the verdict does not depend on the order of additions.

A null text is the empty text and has no spans. Repeated rows each get their spans. Further columns stay as they are; ``base`` and
``spans`` are added (columns of that name are replaced). Spans are code points, end exclusive, ordered by start, then kind as listed
in ``KINDS``. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the least length may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

CANDIDATE = r"[A-Za-z0-9+/_-]{20,4096}"
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words and forms that look random without being secret.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)0123456789|9876543210|abcdefghij|zyxwvutsrq",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(md5|sha1|sha224|sha256|sha384|sha512)-",
)
STEP = 256  # matches whose places are summed up together
UNIT = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    alphabet: str
    window: int
    bits: float  # least entropy of a window

    @property
    def most(self) -> int:
        """Largest sum of n * log2(n) of a hot window, in millionths."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdef", 16, 3.0),
    CharacterClass("entropy_upper", DIGITS + LOWER.upper(), 16, 3.25),
    CharacterClass("entropy_mixed", DIGITS + LOWER + LOWER.upper() + "+/_-", 20, 3.75),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,text:string>>"


def bits_of_counts(window: int) -> list[int]:
    """n * log2(n) of 0 .. window, in millionths."""
    return [0, *(round(n * math.log2(n) * UNIT) for n in range(1, window + 1))]


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost matches that do not overlap: what lies between them and the matches themselves
    alternate, so running sums of their lengths are the places. Sums run in steps of ``STEP`` matches, so that many of them cost no more each."""
    found, gaps, none = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), F.array().cast(FOUND)
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))

    def one(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text")))
        return F.struct(end.alias("at"), F.concat(done["out"], span).alias("out"))

    def step(done: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(done["all"], k * STEP + 1, F.lit(STEP)), F.struct(done["at"].alias("at"), none.alias("out")), one)
        out = F.concat(done["out"], F.array(part["out"]))
        return F.struct(part["at"].alias("at"), out.alias("out"), done["all"].alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("out"), both.alias("all"))
    steps = F.sequence(F.lit(0), F.floor((F.regexp_count(text, F.lit(pattern)) - 1) / STEP).cast("int"))
    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda done: F.flatten(done["out"]))).otherwise(none)


def hot_spans(chars: Column, cls: CharacterClass) -> Column:
    """array<struct<start, end>> of the merged hot windows of an array of characters."""
    width, empty = cls.window, F.array().cast("array<struct<start:int,end:int>>")
    table = F.array(*map(F.lit, bits_of_counts(width))).cast("array<bigint>")
    codes = F.transform(chars, lambda c: F.when(c == "", -1).otherwise(F.instr(F.lit(cls.alphabet), c) - 1))  # digits are codes 0 .. 9
    none = F.array_repeat(F.lit(0), len(cls.alphabet))

    def change(counts: Column, code: Column, by: int) -> Column:
        n = F.get(counts, code)
        return F.when(code >= 0, F.get(table, n + by) - F.get(table, n)).otherwise(F.lit(0).cast("bigint"))

    def is_digit(code: Column) -> Column:
        return F.when((code >= 0) & (code < 10), 1).otherwise(0)

    def is_member(code: Column) -> Column:
        return F.when(code >= 0, 1).otherwise(0)

    def drop(counts: Column, code: Column) -> Column:
        return F.transform(counts, lambda n, j: F.when(j == code, n - 1).otherwise(n))

    def add(counts: Column, code: Column) -> Column:
        return F.transform(counts, lambda n, j: F.when(j == code, n + 1).otherwise(n))

    def leave(s: Column) -> Column:
        """The state without the character that falls out of the window."""
        code = F.when(s["at"] >= width, F.get(s["codes"], s["at"] - width)).otherwise(-1)
        return F.struct(
            s["at"].alias("at"),
            s["codes"].alias("codes"),
            drop(s["counts"], code).alias("counts"),
            (s["bits"] + change(s["counts"], code, -1)).alias("bits"),
            (s["inside"] - is_member(code)).alias("inside"),
            (s["digits"] - is_digit(code)).alias("digits"),
            s["out"].alias("out"),
        )

    def enter(s: Column, code: Column) -> Column:
        return F.struct(
            (s["at"] + 1).alias("at"),
            s["codes"].alias("codes"),
            add(s["counts"], code).alias("counts"),
            (s["bits"] + change(s["counts"], code, 1)).alias("bits"),
            (s["inside"] + is_member(code)).alias("inside"),
            (s["digits"] + is_digit(code)).alias("digits"),
            s["out"].alias("out"),
        )

    def judge(s: Column) -> Column:
        hot = (s["inside"] == width) & s["digits"].between(2, width - 2) & (s["bits"] <= cls.most)
        last = F.get(s["out"], F.size(s["out"]) - 1)
        begin = s["at"] - width
        fresh = F.concat(s["out"], F.array(F.struct(begin.alias("start"), s["at"].alias("end"))))
        grown = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(last["start"].alias("start"), s["at"].alias("end"))))
        out = F.when(~hot, s["out"]).when(F.coalesce(last["end"] >= begin, F.lit(False)), grown).otherwise(fresh)
        return F.struct(*(s[c].alias(c) for c in ("at", "codes", "counts", "bits", "inside", "digits")), out.alias("out"))

    start = F.struct(
        F.lit(0).alias("at"), codes.alias("codes"), none.alias("counts"), F.lit(0).cast("bigint").alias("bits"),
        F.lit(0).alias("inside"), F.lit(0).alias("digits"), empty.alias("out"),
    )

    def then(value: Column, make) -> Column:
        """``make`` over a value that is computed once."""
        return F.element_at(F.transform(F.array(value), make), 1)

    def step(s: Column, code: Column) -> Column:
        return then(then(leave(s), lambda x: enter(x, code)), judge)

    return F.aggregate(codes, start, step, lambda s: s["out"])


def _kind(spans: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of hot windows of all classes in the candidates that no pattern of the allow-list matches."""

    def suspect(s: Column) -> Column:
        yes = s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")
        for pattern in allowed:
            yes = yes & ~s["text"].rlike(pattern)
        return yes

    wanted = F.filter(located(text, CANDIDATE), suspect)

    def spans(s: Column) -> Column:
        chars = F.split(s["text"], "")
        found = F.concat(*(_kind(hot_spans(chars, c), c.kind) for c in CLASSES))
        return F.transform(
            found,
            lambda h: F.struct((h["start"] + s["start"]).alias("start"), h["place"].alias("place"), (h["end"] + s["start"]).alias("end"), h["kind"].alias("kind")),
        )

    # text without both a letter and a digit in a row of the alphabet has no window to judge
    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(wanted, spans))).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns) and ``spans`` (these and the entropy's): array<struct<start, place, end, kind>>."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(located(whole, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGNED)
    base = F.array_sort(F.concat(_kind(assigned, "assign"), _kind(located(whole, ACCESS), "access"), _kind(located(whole, HEX), "hex")))
    rows = docs.withColumn("base", base)
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base"), entropy_spans(whole, allowed))))


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
