"""Functions over arrays of numbers: token lists and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ensure_eos(ids: Column, eos: int) -> Column:
    """The list with the end token behind it, if it isn't there; an empty list becomes that token alone."""
    return F.when(F.size(ids) == 0, F.array(F.lit(eos))).when(F.element_at(ids, -1) == eos, ids).otherwise(F.array_append(ids, F.lit(eos)))


def truncate(ids: Column, max_tokens: int, eos: int, reserve_eos: bool = True) -> Column:
    """At most max_tokens with the end token; without reserve_eos, that token may come on top."""
    return ensure_eos(F.slice(ids, 1, max_tokens - 1 if reserve_eos else max_tokens), eos)


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The vector at length 1, in double precision; the zero vector stays."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def first_dimensions(v: Column, m: int) -> Column:
    """The first m dimensions, normalised."""
    return normalise(F.slice(v, 1, m))


def pool_eos(states: Column, mask_sum: Column) -> Column:
    """The state at the last token that counts."""
    return F.element_at(states, mask_sum.cast("int"))


def learning_rate(step: Column, warmup: int, steps: int) -> Column:
    """The factor of a linear warm-up followed by a linear decay to 0."""
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), (F.lit(steps) - step) / float(max(1, steps - warmup))))


def pad_right(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (length - F.size(ids)).cast("int")))


def mask_right(ids: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), (length - F.size(ids)).cast("int")))
