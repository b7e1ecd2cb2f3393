"""Expressions on long texts and arrays that cost in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points per piece of a text that is taken apart by places.
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Inclusive running results of a non-empty array of ints, in blocks, so that long arrays stay cheap.

    ``combine`` is associative.
    """
    none = F.array().cast("array<int>")

    def folded(xs: Column) -> Column:
        def add(a: Column, v: Column) -> Column:
            return F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(combine(F.try_element_at(a, F.lit(-1)), v))))

        return F.aggregate(xs, none, add)

    def blocks(xs: Column) -> Column:
        count = F.floor((F.size(xs) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda b: folded(F.slice(xs, b * block + 1, F.lit(block))))

    def joined(parts: Column) -> Column:
        def moved(ends: Column) -> Column:
            shifted = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: combine(F.get(ends, i - 1), v))))
            return F.flatten(shifted)

        return let(folded(F.transform(parts, lambda x: F.element_at(x, -1))), moved)

    return let(let(values, blocks), joined)


def pieces(text: Column) -> Column:
    """The text as an array of strings of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given as ``pieces``."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    own = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    inside = F.substring(own(first), start % PIECE + 1, end - start)
    middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(own(first), start % PIECE + 1, F.lit(PIECE)), middle, F.substring(own(last), F.lit(1), end % PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with ``fill(span, done)`` in the place of every span (structs with s and e, sorted by s).

    ``done`` is where the spans before it end; a span that begins before overlaps one of them.
    """

    def made(parts: Column, spans: Column) -> Column:
        def joined(ends: Column) -> Column:
            def step(m: Column, i: Column) -> Column:
                done = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
                return F.concat(between(parts, done, m["s"]), fill(m, done))

            return F.concat(F.array_join(F.transform(spans, step), ""), between(parts, F.element_at(ends, -1), F.length(text)))

        return let(running(F.transform(spans, lambda m: m["e"].cast("int")), F.greatest), joined)

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(pieces(text), lambda parts: let(spans, lambda own: made(parts, own)))).otherwise(text)
