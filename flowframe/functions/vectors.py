"""Row statistics of array columns and column means over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def mean(vector: Column) -> Column:
    return F.aggregate(doubles(vector), F.lit(0.0), lambda a, x: a + x) / F.size(vector)


def std(vector: Column) -> Column:
    """The population's standard deviation."""
    m = mean(vector)
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(vector))


def median(vector: Column) -> Column:
    s, n = F.array_sort(doubles(vector)), F.size(vector)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def feature_means(df: DataFrame, vector: str) -> DataFrame:
    """(pos, mean) of each position; combined before the shuffle, one row a position."""
    return df.select(F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def centered(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Adds the vector less the means of its positions; the means are as many as a vector has positions."""
    means = [r["mean"] for r in feature_means(df, vector).orderBy("pos").collect()]
    return df.withColumn(name, F.zip_with(doubles(F.col(vector)), F.array(*map(F.lit, means)).cast("array<double>"), lambda x, m: x - m))
