"""Expressions over arrays: normalising, patches, masks and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.hashing import bernoulli, hash_key
from packetloom.functions.octets import FEATURE_BYTES, byte_values, crop_and_pad


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    Spark evaluates what a lambda captures anew for every element, so an expression that a lambda
    refers to has to be a lambda variable itself.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def mean(a: Column) -> Column:
    return bind(a, lambda v: total(v) / F.size(v))


def sample_variance(a: Column) -> Column:
    """Unbiased variance; null for fewer than two values."""

    def spread(v: Column, m: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
        return F.when(F.size(v) > 1, squares / (F.size(v) - 1))

    return bind(a, lambda v: bind(total(v) / F.size(v), lambda m: spread(v, m)))


def unit_floats(b: Column, width: int = FEATURE_BYTES) -> Column:
    """Bytes divided by 255, cut or zero-filled to ``width`` values."""
    return F.transform(byte_values(crop_and_pad(b, width)), lambda v: v / F.lit(255.0))


def affine(a: Column, mean: float, std: float) -> Column:
    """``(v - mean) / std`` for every value."""
    return F.transform(a, lambda v: (v - F.lit(mean)) / F.lit(std))


def pad_values(a: Column, width: int) -> Column:
    """Cut to ``width`` values, or filled up with 0.0."""
    missing = F.greatest(F.lit(width) - F.size(a), F.lit(0))
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), missing)), 1, width)


def normalised(b: Column, width: int, mean: float, std: float, pad: str = "before") -> Column:
    """Unit floats of a byte string, normalised and filled up to ``width``.

    With ``pad="before"`` the fill is normalised too and ends as ``-mean/std``; with ``"after"``
    it stays 0.
    """

    def scaled(octets: Column) -> Column:
        return F.transform(byte_values(octets), lambda v: (v / F.lit(255.0) - F.lit(mean)) / F.lit(std))

    if pad == "before":
        return scaled(crop_and_pad(b, width))
    if pad == "after":
        return pad_values(scaled(F.substring(b, 1, width)), width)
    raise ValueError(f"pad must be 'before' or 'after', not {pad!r}")


def patchify(a: Column, patch: int, count: int) -> Column:
    """``count`` consecutive slices of ``patch`` values."""
    places = F.sequence(F.lit(0), F.lit(count - 1))
    return bind(a, lambda v: F.transform(places, lambda p: F.slice(v, p * patch + 1, F.lit(patch))))


def unpatchify(patches: Column) -> Column:
    return F.flatten(patches)


def effective_patches(length: Column, width: int, patch: int) -> Column:
    """Patches that hold any real content."""
    return F.ceil(F.least(length, F.lit(width)) / F.lit(patch)).cast("int")


def attention_mask(effective: Column, count: int) -> Column:
    """1 for the first ``effective`` of ``count`` patches, 0 for the others."""
    return F.concat(
        F.array_repeat(F.lit(1), effective),
        F.array_repeat(F.lit(0), F.lit(count) - effective),
    )


def masking(seed: int | str, ids: list[str], count: int, ratio: float) -> tuple[Column, Column, Column]:
    """Random masking of ``count`` patches: ``(ids_shuffle, ids_restore, mask)``.

    Patches are ordered by noise; the first ``int(count * (1 - ratio))`` are kept (mask 0), the
    others removed (mask 1). ``ids_restore`` is the inverse permutation, and the mask is in
    patch order.
    """
    keep = int(count * (1 - ratio))
    positions = F.sequence(F.lit(0), F.lit(count - 1))
    noise = F.transform(positions, lambda p: F.struct(hash_key(seed, *ids, p).alias("h"), p.alias("p")))
    shuffle = F.transform(F.array_sort(noise), lambda s: s["p"])
    restore = bind(shuffle, lambda s: F.transform(positions, lambda p: (F.array_position(s, p) - 1).cast("int")))
    mask = F.transform(restore, lambda r: F.when(r < keep, 0).otherwise(1))
    return shuffle, restore, mask


def patch_targets(patches: Column, eps: float = 1e-6) -> Column:
    """Every patch brought to mean 0 and unit (unbiased) variance."""

    def scaled(patch: Column) -> Column:
        moments = F.struct(mean(patch).alias("m"), F.sqrt(sample_variance(patch) + F.lit(eps)).alias("s"))
        return bind(moments, lambda z: F.transform(patch, lambda v: (v - z["m"]) / z["s"]))

    return F.transform(patches, scaled)


def patch_errors(pred: Column, target: Column) -> Column:
    """Mean squared error of every patch."""

    def error(p: Column, t: Column) -> Column:
        return mean(F.transform(F.arrays_zip(p.alias("p"), t.alias("t")), lambda z: (z["p"] - z["t"]) * (z["p"] - z["t"])))

    return F.zip_with(pred, target, error)


def mask_tokens(tokens: Column, special: Column, seed: int | str, ids: list[str], ratio: float, mask: str) -> Column:
    """Tokens with a fraction replaced by ``mask``; positions flagged in ``special`` are exempt."""

    def one(pair: Column, i: Column) -> Column:
        chosen = bernoulli(hash_key(seed, *ids, i), ratio) & ~pair["special"]
        return F.when(chosen, F.lit(mask)).otherwise(pair["token"])

    return F.transform(F.arrays_zip(tokens.alias("token"), special.alias("special")), one)


def softmax(scores: Column, bias: Column | None = None) -> Column:
    """Softmax of a score row after adding a bias row (large negatives switch a position off)."""
    if bias is not None:
        scores = F.zip_with(scores, bias, lambda s, b: s + b)
    powers = bind(scores, lambda v: bind(F.array_max(v), lambda top: F.transform(v, lambda s: F.exp(s - top))))
    return bind(powers, lambda v: bind(total(v), lambda t: F.transform(v, lambda e: e / t)))


def cross_entropy(scores: Column, label: Column) -> Column:
    """Negative log probability of the class id under the softmax of the scores."""

    def loss(v: Column, top: Column) -> Column:
        return F.log(total(F.transform(v, lambda s: F.exp(s - top)))) + top - F.element_at(v, (label + 1).cast("int"))

    return bind(scores, lambda v: bind(F.array_max(v), lambda top: loss(v, top)))


def argmax(scores: Column) -> Column:
    """Position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
