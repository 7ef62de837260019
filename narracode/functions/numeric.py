"""Numeric, array and map expressions. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    A column used inside a lambda is evaluated again for each element; binding it as a
    lambda variable first keeps array work linear.
    """
    return F.transform(F.array(value), body)[0]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def shifted_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))


def softmax(values: Column) -> Column:
    return let(
        shifted_exp(values),
        lambda e: let(array_sum(e), lambda total: F.transform(e, lambda v: v / total)),
    )


def log_sum_exp(values: Column) -> Column:
    return F.array_max(values) + F.log(array_sum(shifted_exp(values)))


def argmax(values: Column) -> Column:
    """Index from zero of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cut(values: Column, start: int, length: int) -> Column:
    """``length`` elements from index ``start``, counted from zero."""
    return F.slice(values, start + 1, length)


def map_get(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)


def half_even(x: Column) -> Column:
    return F.bround(x)


def hex_word(text: Column) -> Column:
    """First 32 bits of the md5 of ``text`` as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hex_uniform(digest: Column, word: int) -> Column:
    """A number in [0, 1) from the n-th 32-bit word (0..3) of a hex digest."""
    bits = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)


def hash_uniform(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the concatenation of ``parts``."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return hex_uniform(F.md5(text), 0)
