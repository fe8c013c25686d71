import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source[, lang]]), with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("id", "hash", "row", "kept", "spans", "base", "fp", "key", "size", "target", "host", "rule", "n", "range"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Null, empty, blank and repeated rows, one id with two texts.
ODD = [(None, None, None, None), (None, "", "s1", "en"), (1, None, "s1", None), (2, "", "s1", "en"), (3, " \n\t ", "s2", "en"), (4, "same text again", "s1", "en"), (4, "same text again", "s1", "en"), (5, "one", "s1", "en"), (5, "two", None, "fr"), (6, "x" * 150_000, "s1", "en"), (7, "😀é漢字 ok", "s2", "fr")]
