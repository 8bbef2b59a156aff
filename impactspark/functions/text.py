"""Regex building blocks for policy text, all native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from impactspark import fixed

# ignore case, in Unicode; only \n ends a line for `.`
FLAGS = "(?iud)"
# a run of whitespace that is not a single blank already
LOOSE_SPACE = r"(?U)[\s\x1c-\x1f]{2,}|[[\s\x1c-\x1f]&&[^ ]]"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, ignoring case."""
    return F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(group))


def turkish(text: Column) -> Column:
    """Whether one of the two Turkish i's is in it, which fold to i in patterns
    but not in lower case."""
    return text.contains("\u0130") | text.contains("\u0131")


def mentions(text: Column, words: Iterable[str], low: Column | None = None, odd: Column | None = None) -> Column:
    """Whether a match that needs one of the words is possible: a plain
    substring search, much cheaper than the pattern it guards.

    `low` is the lower-cased text and `odd` what `turkish` says, where a caller
    already has them. An odd text is always let through.
    """
    low = F.lower(text) if low is None else low
    hit = turkish(text) if odd is None else odd
    for w in words:
        hit = hit | low.contains(w)
    return hit


def from_first(text: Column, words: Iterable[str], low: Column | None = None, odd: Column | None = None, lead: int = 0) -> Column:
    """The text from the first of the words on, and `lead` characters before:
    no match that holds one of them in that place begins earlier. Only of a text
    that mentions one. Lower case keeps the places of characters in all but odd
    texts, which stay whole."""
    low = F.lower(text) if low is None else low
    odd = turkish(text) if odd is None else odd
    places = F.array(*[F.instr(low, w) for w in words])
    first = F.array_min(F.filter(places, lambda p: p > 0))
    start = F.greatest(first - lead, F.lit(1))
    return F.when(odd, text).otherwise(F.substring(text, start, F.lit(2**31 - 1)))


def percentages(text: Column) -> Column:
    return F.transform(matches(text, fixed.PERCENT, 1), lambda m: m.try_cast("double"))


def _scale(match: Column, strict: bool) -> Column:
    low = F.lower(match)
    if strict:
        unit = F.regexp_extract(low, r"([a-z]+)$", 1)
        return (
            F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).otherwise(1.0)
        )
    return (
        F.when(low.contains("million") | match.contains("M"), 1e6)
        .when(low.contains("billion") | match.contains("B"), 1e9)
        .otherwise(1.0)
    )


def money_amounts(text: Column, mode: str = "compat") -> Column:
    """Dollar amounts in order.

    `compat` keeps the customary reading: only two decimals belong to an
    amount, and a bare capital M or B right behind it scales it even when it
    starts a word. `strict` takes any decimals and whole units only.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == "strict"

    def value(m: Column) -> Column:
        number = F.regexp_replace(m, "[^0-9.]", "").try_cast("double")
        return number * _scale(m, strict)

    found = matches(text, fixed.MONEY_STRICT if strict else fixed.MONEY)
    return F.array_compact(F.transform(found, value))


def first_amount(
    text: Column,
    context: str,
    words: Iterable[str],
    mode: str = "compat",
    low: Column | None = None,
    odd: Column | None = None,
    lead: int = 0,
) -> Column:
    """First amount of the first context match that holds one. A match holds one
    of the words at most `lead` characters behind its start."""
    behind = from_first(text, words, low, odd, lead)
    found = F.when(mentions(text, words, low, odd), matches(behind, context))
    amounts = F.transform(found, lambda m: F.get(money_amounts(m, mode), F.lit(0)))
    return F.get(F.array_compact(amounts), F.lit(0))


def funding_change(text: Column, low: Column | None = None, odd: Column | None = None) -> Column:
    """Signed percentage of the first funding phrase that holds one."""

    def signed(m: Column) -> Column:
        size = F.abs(F.get(percentages(m), F.lit(0)))
        return F.when(F.lower(m).rlike(fixed.FUNDING_DOWN), -size).otherwise(size)

    possible = mentions(text, fixed.FUNDING_WORDS, low, odd)
    found = F.when(possible, matches(from_first(text, fixed.FUNDING_WORDS, low, odd), fixed.FUNDING_CONTEXT))
    return F.get(F.array_compact(F.transform(found, signed)), F.lit(0))


def tuition_cap(text: Column, near: bool = False, low: Column | None = None, odd: Column | None = None) -> Column:
    """First percentage of the whole text when a cap phrase occurs anywhere;
    with `near`, the first one within 100 characters after a cap phrase."""
    possible = mentions(text, fixed.CAP_WORDS, low, odd)
    behind = from_first(text, fixed.CAP_WORDS, low, odd)
    if near:
        spans = F.when(possible, matches(behind, fixed.CAP_PHRASE + r".{0,100}"))
        close = F.transform(spans, lambda m: F.get(percentages(m), F.lit(0)))
        return F.get(F.array_compact(close), F.lit(0))
    capped = possible & behind.rlike(FLAGS + fixed.CAP_PHRASE)
    return F.when(capped, F.get(percentages(text), F.lit(0)))


def institution_types(text: Column, low: Column | None = None) -> Column:
    """Types named in the text; all of them when none is."""
    low = F.lower(text) if low is None else low
    named = []
    for kind, words in fixed.TYPE_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        named.append(F.when(hit, kind))
    found = F.array_compact(F.array(*named))
    every = F.array(*[F.lit(k) for k in fixed.TYPE_WORDS])
    # the texts are searched once: `found` stands here in one place only
    return F.get(F.filter(F.array(found, every), lambda kinds: F.size(kinds) > 0), F.lit(0))


def clean_text(text: Column, repair_hyphens: bool = False) -> Column:
    """Footers and bill headers out, whitespace runs to one space, trimmed.

    Words broken by a hyphen at a line end stay broken unless asked for, since
    line ends are gone once whitespace is collapsed.
    """
    out = F.regexp_replace(text, fixed.PAGE_FOOTER, "")
    out = F.when(out.contains(" Bill "), F.regexp_replace(out, fixed.BILL_HEADER, "")).otherwise(out)
    if repair_hyphens:
        out = F.regexp_replace(out, r"(?U)(\w)-[^\S\n]*\n\s*(\w)", "$1$2")
    return F.trim(F.regexp_replace(out, LOOSE_SPACE, " "))
