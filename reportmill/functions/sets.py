"""Columns over class sets (arrays of distinct class names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import taxonomy as tx
from .text import literal


def with_parents(classes: Column) -> Column:
    """A child class implies its parent, one level up."""
    return F.when(F.arrays_overlap(classes, literal(tx.CHILDREN)), F.array_union(classes, literal([tx.PARENT]))).otherwise(classes)


def to_groups(classes: Column, names=tuple(tx.GROUPS)) -> Column:
    """Groups with a member in the set."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(classes, literal(tx.GROUPS[g])), F.lit(g)) for g in names]))


def any_acute(classes: Column) -> Column:
    return F.size(F.array_except(classes, literal(tx.NOT_ACUTE))) > 0


def truth_set(positive: Column, uncertain: Column, policy: str = "ignore") -> Column:
    """Positive classes (with the uncertain ones if policy is 'ones'); {No Finding} if there are none."""
    out = F.array_union(positive, uncertain) if policy == "ones" else positive
    return F.when(F.size(out) > 0, out).otherwise(literal(["No Finding"]))


def is_correct(predicted: Column, truth: Column) -> Column:
    """Both normal, or a class in common."""
    return F.when(F.array_contains(truth, "No Finding"), F.size(predicted) == 0).otherwise(F.arrays_overlap(predicted, truth))


def confusion(truth: Column, predicted: Column, classes) -> list[Column]:
    """tp, fp and fn of one row over the classes."""
    t, p = F.array_intersect(truth, literal(classes)), F.array_intersect(predicted, literal(classes))
    tp = F.size(F.array_intersect(t, p)).cast("long")
    return [tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(t) - tp).alias("fn")]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def prf(tp, fp, fn) -> list[Column]:
    """precision, recall and f1 from counts."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))))


def joined(classes: Column) -> Column:
    """A set as text, sorted."""
    return F.array_join(F.array_sort(classes), "|")
