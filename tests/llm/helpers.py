from __future__ import annotations

import random

#: More columns, named as the operators name their own, or awkwardly.
CLASHING = (
    "score", "node", "size", "position", "rank", "row", "at", "one", "id", "none", "won", "toxic_score", "toxic_predicted", "found_lang_pred", "found_score", "Found_Lang_Set",
    "whole_text", "n_known", "ids", "hits", "__node", "__row", "__key", "__salt", "__t0", "__bin", "__text", "part", "before", "bucket", "signature", "a.b",
)
SCHEMA = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in CLASHING]])


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    """Documents from (doc_id, text, lang, source), with more columns whose names clash."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *CLASHING) for i, t, g, s in rows], SCHEMA)
