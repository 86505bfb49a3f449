"""Column helpers for text, offsets and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.catalog import JS_SPACE_CHARACTERS

# Arrays are folded in blocks of this many elements (see ``fold_emit``).
BLOCK = 256


def js_trim(value: Column) -> Column:
    """Trim the ECMAScript white space set, which is wider than SQL ``trim``."""
    return F.btrim(value, F.lit(JS_SPACE_CHARACTERS))


def or_default(value: Column, default: Column) -> Column:
    """``value || default``: null and empty text count as missing, blanks do not."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def base_name(path: Column) -> Column:
    """Last path segment; both slash directions separate segments."""
    return F.element_at(F.split(path, r"[\\/]", -1), -1)


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def units(text: Column, utf16: bool) -> Column:
    """Length in code points, or in UTF-16 units."""
    if not utf16:
        return F.length(text)
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def half_up(number: Column) -> Column:
    """Round halves towards plus infinity (-0.5 gives 0, 2.5 gives 3)."""
    return F.floor(number + F.lit(0.5))


def redact(value: Column) -> Column:
    """Fixed format: header mask, short mask, or first four + '...' + last two UTF-16 units.

    A character that four or two units would cut in two is left out.
    """
    four, two = F.substring(value, 1, 4), F.right(value, F.lit(2))
    head = F.when(units(four, True) == 4, four)
    for n in (3, 2):
        head = head.when(units(F.substring(value, 1, n), True) <= 4, F.substring(value, 1, n))
    tail = F.when(units(two, True) == 2, two).when(units(F.right(value, F.lit(1)), True) <= 2, F.right(value, F.lit(1)))
    return (
        F.when(F.startswith(value, F.lit("-----BEGIN")), F.lit("-----BEGIN ***-----"))
        .when(units(value, True) <= 6, F.concat(F.substring(value, 1, 1), F.lit("***")))
        .otherwise(F.concat(head, F.lit("..."), tail))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_emit(
    items: Column,
    state: dict[str, Column],
    step: Callable[[dict[str, Column], Column], tuple[dict[str, Column], Column]],
    emitted_type: str,
    leftover: Callable[[dict[str, Column]], Column] | None = None,
) -> Column:
    """Left fold over an array that emits elements on the way.

    ``step(state, item)`` returns the next state and an array to emit. Growing
    one output array copies it at each step, so the fold runs in blocks: an
    inner fold fills a small array per block and the outer fold collects the
    blocks. Work stays near linear for files with very many matches.
    """
    empty = F.array().cast(f"array<{emitted_type}>")
    names = list(state)

    def fields(acc: Column) -> dict[str, Column]:
        return {name: acc.getField(name) for name in names}

    def pack(values: dict[str, Column], out: Column) -> Column:
        return F.struct(*[values[name].alias(name) for name in names], out.alias("out"))

    def inner(acc: Column, item: Column) -> Column:
        after, emitted = step(fields(acc), item)
        return pack(after, F.concat(acc.getField("out"), emitted))

    def outer(acc: Column, block: Column) -> Column:
        return F.aggregate(
            F.slice(items, block * BLOCK + 1, BLOCK),
            pack(fields(acc), empty),
            inner,
            lambda done: pack(fields(done), F.concat(acc.getField("out"), F.array(done.getField("out")))),
        )

    def finish(acc: Column) -> Column:
        out = F.flatten(acc.getField("out"))
        return F.concat(out, leftover(fields(acc))) if leftover else out

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    folded = F.aggregate(
        blocks,
        pack(state, F.array().cast(f"array<array<{emitted_type}>>")),
        outer,
        finish,
    )
    return F.when(F.size(items) > 0, folded).otherwise(empty)


def cut(text: Column, offsets: Column) -> Column:
    """Pieces of the text between consecutive ascending offsets, the first from 0.

    The text behind the last offset is left out. Cut block by block: taking
    each piece from the whole text would walk the text once per piece.
    ``offsets`` should be a plain column, as it is used many times.
    """

    def at(index: Column) -> Column:
        return F.when(index < 0, F.lit(0)).otherwise(F.get(offsets, index))

    def block_pieces(block: Column) -> Column:
        low = at(block * BLOCK - 1)
        last = F.least(block * BLOCK + BLOCK, F.size(offsets)) - 1
        return let(
            F.substring(text, low + 1, at(last) - low),
            lambda part: F.transform(
                F.sequence(block * BLOCK, last),
                lambda i: F.substring(part, at(i - 1) - low + 1, at(i) - at(i - 1)),
            ),
        )

    blocks = F.sequence(F.lit(0), F.floor((F.size(offsets) - 1) / BLOCK).cast("int"))
    empty = F.array().cast("array<string>")
    return F.when(F.size(offsets) > 0, F.flatten(F.transform(blocks, block_pieces))).otherwise(empty)
