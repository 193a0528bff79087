"""Scalar column expressions. All are built from Spark functions, none is a UDF."""
