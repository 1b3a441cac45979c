"""Small documents for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, target double, root long, node long"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(a, t, g, s, len(t or ""), 7, "k", 1.5, 1, 2) for a, t, g, s in rows], DOCS)


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in ("ar", "be", "cu", "do", "el", "fi", "go", "hu", "in", "jo") for b in ("ran", "tel", "mos", "vik", "dal", "pun", "ret", "sil")]
    return " ".join(rng.choice(words) for _ in range(n))
