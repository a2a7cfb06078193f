"""Bounded samples of labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Label values, at most: so the sample that is broadcast and collected is bounded.
MOST_VALUES = 500


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3. A null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, values: list | None = None, longest: int = 1 << 20) -> list[tuple]:
    """At most ``most`` (doc_id, text, label) of each label value: the first by the hashed order of the id, held out rows aside.

    ``labels`` has doc_id and ``label`` and is read without texts; only the drawn ids, at most ``most`` a value, meet
    ``docs``, by broadcast. Over ``MOST_VALUES`` label values are an error. Of an id that ``labels`` or ``docs`` repeats, one row counts. Texts over ``longest`` bytes are
    left out of training, never cut. ``values``: the label values (found if None).
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    if values is None:
        values = [r[0] for r in known.select("label").distinct().limit(MOST_VALUES + 1).collect()]
        if len(values) > MOST_VALUES:
            raise ValueError(f"over {MOST_VALUES} label values")
    ids = None
    for v in values:
        part = known.filter(F.col("label") == v).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return []
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") <= longest)
    return sorted({r["doc_id"]: (r["doc_id"], r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"], str(r["label"])), reverse=True)}.values())
