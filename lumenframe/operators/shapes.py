"""Between long and dense rows, and between a flat population index and its axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(dense: DataFrame, array: str, keys: list[str], index: str = "l", value: str = "value") -> DataFrame:
    """A row for each place of the array; the values in double precision."""
    return dense.select(*keys, F.posexplode(array).alias(index, value)).withColumns({index: F.col(index).cast("long"), value: F.col(value).cast("double")})


def to_dense(long: DataFrame, keys: list[str], index: str = "l", value: str = "value", array: str = "flux") -> DataFrame:
    """The values of each key in the order of the index."""
    gathered = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("a"))
    return gathered.select(*keys, F.transform("a", lambda e: e[value]).alias(array))


def transpose(dense: DataFrame, row: str, array: str, column: str = "s", out: str = "flux") -> DataFrame:
    """(row, values over columns) to (column, values over rows)."""
    return to_dense(to_long(dense, array, [row], column, "value"), [column], row, "value", out)


def flat_population(z: Column, age: Column, alpha: Column, n_age: int, n_alpha: int) -> Column:
    return ((z * n_age + age) * n_alpha + alpha).cast("long")


def population_axes(p: Column, n_age: int, n_alpha: int) -> dict[str, Column]:
    """The axes of a flat population index, the last one fastest."""
    return {"z": F.floor(p / (n_age * n_alpha)).cast("long"), "age": (F.floor(p / n_alpha) % n_age).cast("long"), "alpha": (p % n_alpha).cast("long")}


def tile_of(s: Column | str, size: int = 128) -> Column:
    return F.floor((F.col(s) if isinstance(s, str) else s) / size).cast("long")
