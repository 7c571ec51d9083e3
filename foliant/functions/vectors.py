"""Vectors as arrays, and name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(v: Column | str) -> Column:
    return F.forall(doubles(v), lambda x: F.coalesce(finite(x), F.lit(False)))


def norm(v: Column | str) -> Column:
    """Length of the finite components."""
    return F.sqrt(F.aggregate(F.filter(doubles(v), finite), F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Fixed value: the namespace of point ids.
POINTS = "0a59b45a-32d7-49e8-8658-8cb05d71a9dc"


def uuid5(name: Column | str, namespace: str = POINTS) -> Column:
    """The name-based UUID (version 5): SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_c(name).cast("string"), "UTF-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))).cast("long")))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))
