"""Shingle sets and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.hashing import order_key
from granary.functions.text import bound, tokens


def windows(parts: Column, n: int) -> Column:
    """Space-joined runs of n parts; fewer parts make one run, none an empty array. Distinct, in order."""

    def cut(k: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(k) - n + 1), lambda i: F.array_join(F.slice(k, i, n), " "))
        return F.when(F.size(k) == 0, F.array().cast("array<string>")).when(F.size(k) < n, F.array(F.array_join(k, " "))).otherwise(F.array_distinct(runs))

    return bound(parts, cut)


def shingles(text: Column, n: int = 3) -> Column:
    return windows(tokens(F.coalesce(text, F.lit(""))), n)


def shingles_by_space(text: Column) -> Column:
    """3-word windows of lower-cased words between white space; shorter texts are one window, even the empty one."""

    def cut(k: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(k) - 2)), lambda i: F.array_join(F.slice(k, i, 3), " ")))

    return bound(F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: w != ""), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal, one empty set is unlike any other."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))
    )


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


# ---- arrays side by side, and maps -----------------------------------------


def zipped(**arrays: Column) -> Column:
    """Structs of the arrays' elements at one place, as many as the shortest has; null if one is null."""
    shortest = F.least(*map(F.size, arrays.values())) if len(arrays) > 1 else F.size(next(iter(arrays.values())))
    return F.slice(F.arrays_zip(*[c.alias(k) for k, c in arrays.items()]), F.lit(1), F.greatest(shortest, F.lit(0)))


def _pairs(keys: Column, values: Column) -> Column:
    return F.filter(zipped(k=keys, v=values), lambda x: x["k"].isNotNull())


def dict_of(keys: Column, values: Column) -> Column:
    """A map from two arrays, cut to the shorter; of a key that repeats the last value counts. Null keys are left out."""
    last = lambda pairs, k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]
    of = lambda pairs, names: F.map_from_arrays(names, F.transform(names, lambda k: last(pairs, k)))
    return bound(_pairs(keys, values), lambda pairs: bound(F.array_distinct(pairs["k"]), lambda names: of(pairs, names)))


def summed_by(keys: Column, values: Column) -> Column:
    """A map from each key to the sum of its values, the arrays cut to the shorter; null values count 0, null keys are left out."""
    total = lambda pairs, k: F.aggregate(pairs, F.lit(0.0), lambda s, x: F.when(x["k"] == k, s + F.coalesce(x["v"].cast("double"), F.lit(0.0))).otherwise(s))
    of = lambda pairs, names: F.map_from_arrays(names, F.transform(names, lambda k: total(pairs, k)))
    return bound(_pairs(keys, values), lambda pairs: bound(F.array_distinct(pairs["k"]), lambda names: of(pairs, names)))


def merged(first: Column, second: Column) -> Column:
    """A map with the entries of both; where both have a key, those of the second."""
    return bound(second, lambda s: F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(s, k)), s))


def drawn_places(size: Column, n: Column, *seed: Column) -> Column:
    """n of the places 0 to size - 1, without repeats, in the order of their hashes."""
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(order_key(*seed, i).alias("h"), i.alias("i"))))
    return F.slice(F.transform(ranked, lambda x: x["i"]), F.lit(1), F.greatest(n, F.lit(0)))


def disjoint(a: Column, b: Column) -> Column:
    return ~F.exists(a, lambda x: F.array_contains(b, x))


def subset(a: Column, b: Column) -> Column:
    return F.forall(a, lambda x: F.array_contains(b, x))
