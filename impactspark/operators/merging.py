"""Full outer merge of any number of institution tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.sources.folders import cut_lineage

log = logging.getLogger(__name__)


def _merge(left: DataFrame, right: DataFrame, key: str, null_keys: str) -> DataFrame:
    """Full outer join as matches plus both kinds of leftovers.

    A full outer join can neither broadcast a small side nor have a skewed key
    split at run time. The inner join can do both, and the leftovers only need
    the distinct keys of the other side, which are combined before the shuffle.
    NULL keys meet each other, as in the tables' origin, unless they are to
    stay apart.
    """
    other = "_other_key"
    right = right.withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other)) if null_keys == "meet" else F.col(key) == F.col(other)
    both = left.join(right, same, "inner").drop(other)
    left_only = left.join(right.select(other).distinct(), same, "left_anti")
    right_only = right.join(left.select(key).distinct(), same, "left_anti")
    return both.unionByName(left_only, allowMissingColumns=True).unionByName(
        right_only.withColumnRenamed(other, key), allowMissingColumns=True
    )


def outer_merge(
    tables: Mapping[str, DataFrame], key: str = "institution_id", null_keys: str = "meet"
) -> DataFrame:
    """Fold the tables left to right; clashing names get `_<table>` appended.

    NULL keys of two tables meet each other, all with all; where both have many,
    `null_keys="apart"` keeps each as a row of its own.
    """
    if null_keys not in ("meet", "apart"):
        raise ValueError(f"unknown treatment of NULL keys: {null_keys!r}")
    names = list(tables)
    merged = tables[names[0]]
    for count, name in enumerate(names[1:], start=2):
        df = tables[name]
        if key not in df.columns or key not in merged.columns:
            log.warning("%s has no %s and is not merged", name, key)
            continue
        for c in df.columns:
            if c != key and c in merged.columns:
                df = df.withColumnRenamed(c, f"{c}_{name}")
        merged = _merge(merged, df, key, null_keys)
        if count < len(names):
            merged = cut_lineage(merged)  # the next merge reads it three times
    return merged
