"""Feature vectors of nodes: structure from one-hots, flags and counters; text by hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V


def one_hot_array(value: Column, domain: list[str]) -> Column:
    """1.0 at the place of the lower-cased value; all zeros for null and for what the domain has not."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.transform(F.array(*[F.lit(d) for d in domain]), lambda d: F.when(d == low, 1.0).otherwise(0.0))


def multi_hot_array(categories: Column) -> Column:
    """Eight-wide label of an array of category ids, with or without the year; unknown ids count nothing."""
    clean = F.transform(F.coalesce(categories, F.array()), lambda c: F.regexp_replace(F.upper(F.trim(c)), V.CATEGORY_YEAR + "$", ""))
    return F.transform(F.array(*[F.lit(c) for c in V.CATEGORIES]), lambda c: F.when(F.array_contains(clean, c), 1.0).otherwise(0.0))


def cfg_structure(sub_type: Column, ml: Column) -> Column:
    """38 wide: node type, sub-type, six flags, twelve counters. ml: a struct of flags and counters."""
    flag = lambda f: F.coalesce(ml[f].cast("double"), F.lit(0.0))
    return F.concat(F.array(F.lit(1.0), F.lit(0.0)), one_hot_array(sub_type, V.CFG_SUB_TYPES), F.array(*[flag(f) for f in [*V.CFG_FLAGS, *V.CFG_COUNTERS]]))


def ast_structure(sub_type: Column, ml: Column) -> Column:
    """66 wide: node type, sub-type, visibilities, storage, mutability, event, contract kind.

    ml: a struct of visibility, storage_location, state_mutability, contract_kind and anonymous.
    """
    none = lambda f: F.coalesce(ml[f], F.lit("none"))
    event = F.array(F.when(ml["anonymous"], 1.0).otherwise(0.0), *[F.lit(0.0)] * (len(V.EVENT) - 1))
    return F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), one_hot_array(sub_type, V.AST_SUB_TYPES), one_hot_array(none("visibility"), V.VARIABLE_VISIBILITY), one_hot_array(none("visibility"), V.FUNCTION_VISIBILITY),
        one_hot_array(none("storage_location"), V.STORAGE), one_hot_array(none("state_mutability"), V.MUTABILITY), event, one_hot_array(none("contract_kind"), V.CONTRACT_KIND),
    )


def hashed_text(text: Column, width: int = 64) -> Column:
    """A text as `width` signed counts of its hashed words, of length 1; a blank text is one unknown word.

    The place of a model's embedding: any pandas UDF of the same shape can be put here.
    """
    words = F.filter(F.split(F.lower(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "[UNK]").otherwise(text)), r"[^\p{L}\p{N}\[\]]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(width)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    # lambdas evaluate what they refer to again for each element, save what is bound to a variable
    once = lambda value, f: F.transform(F.array(value), f)[0]
    count = lambda found: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(found, lambda x: x.i == i), F.lit(0.0), lambda n, x: n + x.s))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda n, x: n + x * x))
    return once(once(slots, count), lambda raw: once(norm(raw), lambda size: F.transform(raw, lambda x: (x / F.greatest(size, F.lit(1e-12))).cast("float"))))
