"""Text functions as column expressions. Keys are folded by lower(); Spark has no full case folding (sharp s stays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: White space that is not one space: what is one already need not be replaced by it.
UNEVEN = r"(?U) \s+|[\s&&[^ ]]\s*"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """White space, the non-breaking kind too, as single spaces; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), UNEVEN, " "))


def filled(x: Column | str) -> Column:
    """Whether collapse() leaves something, told without it: as a filter on what it makes it would be made twice."""
    return F.coalesce(_c(x).rlike(r"(?U)\S"), F.lit(False))


def collapse_hyphens(x: Column | str) -> Column:
    """collapse() after soft hyphens are dropped and words cut by a hyphen and white space are joined."""
    whole = F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\u00ad"), F.lit(""))
    return collapse(F.when(F.contains(whole, F.lit("-")), F.regexp_replace(whole, r"(?U)(\w)-\s+(\w)", "$1$2")).otherwise(whole))


def fold(x: Column | str) -> Column:
    return F.lower(collapse(x))


def tokens(x: Column | str) -> Column:
    """Folded words after hyphens are joined; none of an empty text."""
    return F.filter(F.split(F.lower(collapse_hyphens(x)), " "), lambda t: t != "")


def words(x: Column | str) -> Column:
    return F.filter(F.split(collapse(x), " "), lambda t: t != "")


def lookup_key(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", " "))


def int_or_zero(x: Column | str) -> Column:
    """The whole part of a number given as JSON text or as a number; 0 for what is no number, true and false among them."""
    said = _c(x).cast("string")
    return F.coalesce(said.try_cast("int"), F.when(said.rlike(r"^\s*[-+0-9.]"), said.try_cast("double").try_cast("int")), F.lit(0))


def slug(name: Column | str) -> Column:
    """A file name without its last suffix, letters and digits joined by _; document if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(_c(name), F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    s = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", F.lit("document")).otherwise(s)


def sibling_name(name: Column | str, old: str, new: str) -> Column:
    """The name of the next stage's file: suffix old becomes new, or new is added."""
    stem = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    return F.concat(F.when(stem.endswith(old), F.regexp_replace(stem, f"{old}$", new)).otherwise(F.concat(stem, F.lit(new))), F.lit(".json"))


def sentences(x: Column | str) -> Column:
    """Parts after . ! or ? and before a capital, digit, quote or bracket."""
    parts = F.transform(F.split(_c(x), r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""), collapse)
    return F.filter(parts, lambda p: p != "")


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\P{L}", ""))


def meaningful_title(x: Column | str, clean: bool = False) -> Column:
    """Whether a text may be a title; clean says that it is collapsed already."""
    t = _c(x) if clean else collapse(x)
    digits = F.length(F.regexp_replace(t, r"\P{Nd}", ""))
    return (F.length(t).between(1, 160)) & (letters(t) > 0) & ~((letters(t) <= 1) & (digits == 0) & (F.length(t) <= 2))


def heading_like(x: Column | str, n_lines: Column | int = 1, clean: bool = False) -> Column:
    t = _c(x) if clean else collapse(x)
    n = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}", "")) / F.greatest(letters(t), F.lit(1))
    lines = F.lit(n_lines) if isinstance(n_lines, int) else n_lines
    return (F.length(t) <= 140) & meaningful_title(t, clean=True) & n.between(1, 14) & ~t.rlike(r"[.!?]$") & (lines <= 3) & ((n <= 8) | (upper >= 0.55))


def text_heavy(x: Column | str, clean: bool = False) -> Column:
    return (F.length(_c(x)) >= 180) | (F.size(F.split(_c(x), " ") if clean else words(x)) >= 25)


def filled_lines(x: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(x), "\n"), lambda t: F.regexp_replace(t, SPACE, "") != ""))


def stripped(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+|\s+\z", "")


def cut(x: Column | str, most: int, mark: str = "\n[TRUNCATED]") -> Column:
    """The stripped text, cut at most characters with mark after it."""
    t = stripped(x)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+\z", ""), F.lit(mark)))


def last_distinct(history: Column, n: int) -> Column:
    """The last n distinct values, each at the place where it was last."""
    return F.reverse(F.slice(F.array_distinct(F.reverse(history)), 1, n))


def last_of(items: Column, n: int) -> Column:
    """The last n of an array of any size."""
    return F.reverse(F.slice(F.reverse(items), 1, n))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: each distinct token becomes one character, then levenshtein counts.

    A pair may have 1.1 million distinct tokens; the code points of surrogates are left out.
    """
    seen = F.array_distinct(F.concat(a, b))
    place = lambda t: F.array_position(seen, t)
    code = lambda t: F.when(place(t) < 0x8A00, place(t) + 0x4E00).otherwise(place(t) + 0x4E00 + 0x1200)  # noqa: E731  # over the surrogates and what follows
    said = lambda x: F.array_join(F.transform(x, lambda t: _char(code(t))), "")
    return F.levenshtein(said(a), said(b))


def _char(point: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes."""
    p = point.cast("int")
    b = lambda base, shift: F.lpad(F.hex((F.shiftright(p, shift).bitwiseAND(F.lit(63)) + base).cast("long")), 2, "0")
    three = F.concat(F.lpad(F.hex((F.shiftright(p, 12) + 0xE0).cast("long")), 2, "0"), b(0x80, 6), b(0x80, 0))
    four = F.concat(F.lpad(F.hex((F.shiftright(p, 18) + 0xF0).cast("long")), 2, "0"), b(0x80, 12), b(0x80, 6), b(0x80, 0))
    return F.decode(F.unhex(F.when(p < 0x10000, three).otherwise(four)), "UTF-8")
