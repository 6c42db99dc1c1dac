"""Column functions: built from Spark SQL expressions unless a docstring says otherwise."""
