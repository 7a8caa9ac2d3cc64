"""Joins by keys that may be NULL."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, where NULL equals NULL, with the columns of a join by names."""
    names = {key: f"_{key}_of_right" for key in keys}
    renamed = right.withColumnsRenamed(names)
    equal = reduce(and_, (F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()))
    return left.join(renamed, equal, how).drop(*names.values())
