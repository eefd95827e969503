import pytest


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names operators use inside."""

    def add(df):
        from pyspark.sql import functions as F

        for c in ("id", "key", "k", "w", "s", "h", "n", "a", "b", "t", "d", "u", "seen", "reason", "class_id", "check", "bands", "set_id", "rows", "copies", "word", "shape", "person", "org", "length", "item", "part", "kind", "worker", "ids", "words", "holes", "line_no", "mixed", "confidence", "mark", "node", "pos"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
