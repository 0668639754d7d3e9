"""Small tables for the tests."""


def documents(spark, rows):
    """documents from (doc_id, text, source), with the other columns and some whose names may clash."""
    full = [(k, t, "en", s, len(t or ""), 1, "x", 0.5) for k, t, s in ((*r, "s")[:3] for r in rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, score double")
