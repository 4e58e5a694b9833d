"""Folds for resampling from the groups and order of a specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.schema import check
from kinsplit.model import SplitSpec
from kinsplit.plans.numbering import numbered

MOST_GROUPS = 1000


def leave_one_group_out(spec: SplitSpec) -> DataFrame:
    """fold (the group held out), sample_id, role ``train`` or ``assess``.

    Every sample is in every fold, so the result has samples x groups rows; above
    ``MOST_GROUPS`` groups use :func:`grouped_folds`.
    """
    groups = spec.df.select(F.col(spec.group_var).alias("fold")).filter("fold is not null").distinct()
    check(groups.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS, f"More than {MOST_GROUPS} groups; use grouped_folds")
    folds = groups.agg(F.array_sort(F.collect_list("fold")).alias("folds"))  # one row, its size is checked
    return spec.df.crossJoin(F.broadcast(folds)).select(F.explode("folds").alias("fold"), "sample_id", F.col(spec.group_var).alias("group")).select("fold", "sample_id", F.when(F.col("fold") == F.col("group"), "assess").otherwise("train").alias("role"))


def grouped_folds(spec: SplitSpec, v: int = 5) -> DataFrame:
    """sample_id, fold (0 to v-1); a group is never split."""
    check(v > 1, "v must be at least 2")
    number = F.conv(F.substring(F.md5(F.col(spec.group_var).cast("binary")), 1, 8), 16, 10).cast("long")
    return spec.df.select("sample_id", (number % v).cast("int").alias("fold"))


def rolling_origin(spec: SplitSpec, initial: int | None = None, assess: int = 1) -> DataFrame:
    """slice, train_until, assess_from, assess_until over samples ordered by ``time_var``.

    Slices name positions; :func:`ordered_samples` gives each sample its position.
    """
    n = ordered_samples(spec).count()
    first = max(1, int(0.6 * n)) if initial is None else initial
    spark = spec.df.sparkSession
    k = F.col("id")
    return spark.range(max(0, n - first - assess + 1)).select((k + 1).cast("int").alias("slice"), (k + first).cast("long").alias("train_until"), (k + first + 1).cast("long").alias("assess_from"), (k + first + assess).cast("long").alias("assess_until"))


def ordered_samples(spec: SplitSpec) -> DataFrame:
    """position and sample_id of the samples with an order, ties by id."""
    check(spec.time_var is not None, "The specification has no time_var")
    return numbered(spec.df.filter(F.col(spec.time_var).isNotNull()).select("sample_id", spec.time_var), [spec.time_var, "sample_id"], "position").select("position", "sample_id")
