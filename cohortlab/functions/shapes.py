"""Result types of pandas UDFs, as objects: type strings would need a session when modules are imported."""

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

DOUBLE, STRING = DoubleType(), StringType()


def doubles(names: str) -> StructType:
    return StructType([StructField(n, DOUBLE) for n in names.split()])
