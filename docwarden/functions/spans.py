"""Match spans with exact code-point offsets, computed inside the row.

A match is bracketed with a private-use mark by ``regexp_replace`` and the text
is split on the mark: odd parts are values, even parts are the gaps, so a
running sum of lengths gives every offset. Spark copies the state of an array
fold at every step, so running values are taken in short blocks and no fold
carries an array that grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.catalog import (
    CONTEXT_MAX_LENGTH, CONTEXT_STOP_MARKERS, CONTEXT_STRIP_CHARS, DIGIT_REACH, ODD_CASE_LETTERS,
    Pattern, SPACE,
)
from docwarden.functions.once import named
from docwarden.functions.sqltext import quote

MARK = ""
MARK_STAND_IN = ""
BLOCK = 64

# start, priority, end, value: natural order is by start, then priority.
SPAN = "struct<s:int,p:int,e:int,v:string>"


def match_copy(text: Column) -> Column:
    """The text to match on: same length, free of the mark character."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, MARK_STAND_IN)).otherwise(
        text
    )


def has_odd_case(text: Column) -> Column:
    """Text holds a non-ASCII letter that equals an ASCII one without case."""
    return reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ODD_CASE_LETTERS])


#: The space and lower-case letters, the most frequent in running text first.
FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def rare_part(word: str) -> str:
    """The end of a word, of four characters or more, that starts with its rarest letter."""
    starts = range(max(1, len(word) - 3))
    return word[max(starts, key=lambda i: (FREQUENT.find(word[i]) % 99, -i)):]


def holds(text: Column, word: str) -> Column:
    """``contains``, which stops at every occurrence of the first letter: a rarer one is tried first."""
    found, part = F.contains(text, F.lit(word)), rare_part(word)
    return found if part == word else F.contains(text, F.lit(part)) & found


def digits_from(text: Column) -> Column:
    """Code points before which no pattern with ``digits`` matches, and one more to look back at."""
    plain = F.regexp_extract(text, r"^[^\p{Nd}]*+", 0)
    return F.greatest(F.length(plain) - F.lit(DIGIT_REACH), F.lit(0))


def anchor_from(text: Column, anchor: str) -> Column:
    """Code points before the word (between spaces) that holds the first ``anchor``."""
    before = F.substring_index(text, anchor, 1)
    return F.length(before) - F.length(F.substring_index(before, " ", -1))


def text_from(text: Column, start: Column) -> Column:
    """The text after its first ``start`` code points."""
    return F.substring(text, start + 1, F.lit(2**31 - 1))


def guard(pattern: Pattern, text: Column, lowered: Column, odd_case: Column) -> Column:
    """Cheap necessary condition for ``pattern`` to match anywhere."""
    if pattern.probe:
        return text.rlike(pattern.probe)
    searched = lowered if pattern.ignore_case else text
    found = reduce(Column.__or__, [holds(searched, w) for w in pattern.words])
    return found | odd_case if pattern.ignore_case else found


def marked_parts(text: Column, pattern: Pattern) -> Column:
    marked = F.regexp_replace(text, pattern.regex, f"$1{MARK}$2{MARK}$3")
    return F.split(marked, MARK, -1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running sum or maximum of a non-empty array of whole numbers >= 0."""

    def grown(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(combine(F.element_at(a, -1), x)))

    def within(block: Column) -> Column:
        return F.slice(F.aggregate(block, F.array(F.lit(0)), grown), 2, BLOCK)

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return F.transform(starts, lambda at: within(F.slice(v, at, BLOCK)))

    def with_bases(local: Column) -> Column:
        ends = F.transform(local, lambda block: F.element_at(block, -1))
        return F.struct(
            local.alias("local"), F.aggregate(ends, F.array(F.lit(0)), grown).alias("bases")
        )

    def joined(x: Column) -> Column:
        return F.flatten(
            F.transform(
                x["local"],
                lambda block, b: F.transform(block, lambda n: combine(x["bases"][b], n)),
            )
        )

    return named(named(named(values, blocks), with_bases), joined)


def spans_of_parts(parted: Column) -> Column:
    """Spans of one ``struct<p, start, parts>``, in text order."""
    priority, start, parts = parted["p"], parted["start"], parted["parts"]
    ends = running(F.transform(parts, lambda x: F.length(x)), lambda a, b: a + b)

    def listed(till: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(
                (start + till[i - 1]).alias("s"), priority.alias("p"), (start + till[i]).alias("e"),
                parts[i].alias("v"),
            ),
        )

    return F.when(F.size(parts) > 1, named(ends, listed)).otherwise(
        F.array().cast(f"array<{SPAN}>")
    )


def match_spans(
    patterns: Sequence[tuple[int, Pattern]], text: Column, lowered: Column, odd_case: Column,
    digits: tuple[Column, Column] | None = None,
) -> Column:
    """All matches of each pattern on its own, as one array of spans.

    ``digits``: ``digits_from(text)`` and the text from there, which patterns with ``digits`` search.
    """

    def parted(priority: int, pattern: Pattern) -> Column:
        def parts(start: Column, searched: Column) -> Column:
            return F.struct(
                F.lit(priority).alias("p"), start.alias("start"),
                marked_parts(searched, pattern).alias("parts"),
            )

        if pattern.digits and digits is not None:
            start, rest = digits
            return F.when(guard(pattern, rest, lowered, odd_case), parts(start, rest))
        whole = parts(F.lit(0), text)
        if pattern.anchor:
            whole = named(
                anchor_from(text, pattern.anchor), lambda start: parts(start, text_from(text, start))
            )
        return F.when(guard(pattern, text, lowered, odd_case), whole)

    found = F.array(*[parted(priority, pattern) for priority, pattern in patterns])
    return F.flatten(F.transform(F.filter(found, lambda x: x.isNotNull()), spans_of_parts))


def clean_contextual(value: str) -> str:
    """SQL text: collapse whitespace, trim, cut at the first listed marker."""
    chars = quote(CONTEXT_STRIP_CHARS)
    squeezed = f"btrim(regexp_replace({value}, {quote('[' + SPACE + ']+')}, ' '), {chars})"
    cuts = "\n".join(
        f"WHEN locate({quote(m)}, lower(c)) > 1 "
        f"THEN btrim(left(c, locate({quote(m)}, lower(c)) - 1), {chars})"
        for m in CONTEXT_STOP_MARKERS
    )
    # The one-element array names the squeezed value inside the expression.
    return (
        f"transform(array({squeezed}), c -> left(CASE {cuts} ELSE c END, {CONTEXT_MAX_LENGTH}))[0]"
    )


def _pick(run: Column) -> Column:
    """Greedy choice inside one run, ordered by start."""
    by_priority = F.sort_array(
        F.transform(
            run,
            lambda r: F.struct(
                r["p"].alias("p"), r["s"].alias("s"), r["e"].alias("e"), r["v"].alias("v")
            ),
        )
    )

    def add(kept: Column, r: Column) -> Column:
        clash = F.exists(kept, lambda k: (r["s"] < k["e"]) & (r["e"] > k["s"]))
        span = F.struct(
            r["s"].alias("s"), r["p"].alias("p"), r["e"].alias("e"), r["v"].alias("v")
        )
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span)))

    chosen = F.aggregate(by_priority, F.array().cast(f"array<{SPAN}>"), add)
    return F.when(F.size(run) == 1, run).otherwise(F.sort_array(chosen))


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy pick by (priority, start) among overlapping spans.

    Spans sorted by start are cut into runs that do not touch each other; only
    inside a run can one span block another, so the pairwise test never leaves
    the run. The result is ordered by start.
    """

    def cut(x: Column) -> Column:
        spans, till = x["spans"], x["till"]
        last = F.size(spans)
        heads = F.filter(
            F.sequence(F.lit(0), last - 1),
            lambda i: (i == 0) | (spans[i]["s"] >= till[F.greatest(i - 1, F.lit(0))]),
        )
        return named(
            heads,
            lambda h: F.flatten(
                F.transform(
                    h,
                    lambda at, j: _pick(
                        F.slice(
                            spans, at + 1, F.coalesce(F.try_element_at(h, j + 2), last) - at
                        )
                    ),
                )
            ),
        )

    def with_reach(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda c: c["e"]), lambda a, b: F.greatest(a, b))
        return F.struct(spans.alias("spans"), reach.alias("till"))

    return F.when(F.size(candidates) < 2, candidates).otherwise(
        named(named(F.sort_array(candidates), with_reach), cut)
    )
