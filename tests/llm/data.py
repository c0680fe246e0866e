"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside or that need quoting, given to a table as further columns.
CLASHING = ["my col", "a-b", "a.b", "back`tick", "_order", "row", "s", "few", "marked", "crowd", "fp", "node", "band", "key", "carried", "spans", "items", "digest", "places", "n", "m", "start", "held_out", "_label", "_first", "wide", "rep", "slot"]

WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    """Prose, shared passages, copies, a null and an empty text, a null id, a repeated row, a long text."""
    shared = prose(99, 60)
    texts = {
        1: prose(1, 120), 2: None, 3: "", 4: " \n\t ", 5: prose(5, 30) + " " + shared + " " + prose(6, 30), 6: prose(7, 40) + "\n" + shared,
        7: prose(1, 120), 8: "a b c", 9: prose(9, 20_000), 10: shared + " " + shared, 11: "Überall Zürich — naïve 日本語 😀 \x1c x",
        12: prose(1, 120).replace("w7 ", "changed "), 13: "x " * 60, 14: "line one here\nline one here\nline one here\nother",
    }
    out = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", None if t is None else len(t)) for k, t in texts.items()]
    return [*out, (None, prose(5, 30) + " " + shared, "en", None, 5), out[0]]


def docs(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).coalesce(2)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.lit(1)).alias("a map"))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def results(df) -> list[tuple]:
    """Rows in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
