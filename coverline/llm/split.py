"""The learning split, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of all labels together in a sample; of many labels each gets an equal share, one row at least.
SAMPLE = 20_000
#: Labels that a model may have; each is a row at the driver and an output of the network.
MOST_LABELS = 10_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, label: str, per_label: int, in_all: int = SAMPLE, most_labels: int = MOST_LABELS) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label at most, picked by a hash of doc_id, and each label's count, in order.

    ``rows`` has doc_id, the label and what else the sample needs. One aggregate by label (a row for each label comes to the
    driver) sets each label's rate by its number of ids, so the sample costs a scan; only what is picked is shuffled, to
    leave one row for each id and label, the smallest of rows that repeat. All labels are sampled; more than ``most_labels`` are an error,
    as so many are no languages or marks.
    """
    marked = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = marked.groupBy(label).agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} values of {label}")
    if not counts:
        return rows.limit(0), {}
    wanted = max(1, min(per_label, in_all // len(counts)))
    rates = rows.sparkSession.createDataFrame([(r[0], min(1.0, wanted / max(1, r.ids))) for r in counts], f"label {dict(rows.dtypes)[label]}, rate double")
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.join(F.broadcast(rates), F.col(label) == F.col("label")).where(share < F.col("rate"))
    others = [F.min(c).alias(c) for c in rows.columns if c not in ("doc_id", label)]
    keys = picked.groupBy("doc_id", label)
    return keys.agg(*others) if others else picked.select("doc_id", label).distinct(), {r[0]: r.n for r in sorted(counts)}
