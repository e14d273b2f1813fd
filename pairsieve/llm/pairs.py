"""Broken prompt and response pairs: empty, truncated, refusal, copy, other_language.

Shortened versions are found by sorting the distinct responses and comparing each with the next one:
if a text is a proper prefix of any other, it is one of its next neighbour. The sort is by ranges, so
no task holds more than its range, and one row per range is compared across the edges. A shortened
version that ends inside a sentence is truncated; the other signs of truncation are those of
`truncation`. Then the rules for copies, refusals and languages are applied.

Defined cases: a null prompt takes part in no copy or language rule; a null response is empty, and
an empty one has no other defect. One token repeated is none of these defects. A copy has no
language defect. Null ids are dropped; a redelivered id counts once; equal texts are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.llm.truncation import look, truncation
from pairsieve.plans.runtime import cut

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")


def shortened(texts: DataFrame, column: str = "text") -> DataFrame:
    """The distinct texts that are a proper prefix of another one: column `h`, the hash of the text."""
    # of a single word there is nothing to shorten
    d = texts.where(F.col(column).rlike("\\S\\s+\\S")).select(F.rtrim(column).alias("t")).distinct()
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = d.repartitionByRange(n, "t").sortWithinPartitions("t").select("t", F.xxhash64("t").alias("h"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, first = TaskContext.get().partitionId(), None, True
        names = ["part", "edge", "h", "t", "short"]
        for b in batches:
            ts, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for t, h in zip(ts, hs):
                if first:
                    out.append((pid, "first", h, t, False))
                    first = False
                elif t.startswith(last[0]):
                    out.append((pid, None, last[1], None, True))
                last = (t, h)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array(["last"]), pa.array([last[1]], pa.int64()), pa.array([last[0]]), pa.array([False])], names=names)

    seen = cut(ordered.mapInArrow(compare, "part int, edge string, h bigint, t string, short boolean"))
    # two rows a range: the last text of a range and the first of the next range that has any
    w = Window.orderBy("part", F.when(F.col("edge") == "first", 0).otherwise(1))
    edges = seen.where(F.col("edge").isNotNull()).withColumn("next", F.lead("t").over(w)).where((F.col("edge") == "last") & F.expr("startswith(next, t)"))
    return seen.where("short").select("h").unionByName(edges.select("h")).distinct()


def defects(rows: DataFrame) -> DataFrame:
    """id, defect for every defective pair of (id, source, prompt, text)."""
    looked = look(rows, with_defects=True)
    flags = truncation(rows, looked)
    inside = looked.where(F.col("kind").isin("broken", "item", "item_part", "bracket_open", "code_open"))
    short = inside.join(shortened(rows), "h", "left_semi")
    cuts = flags.where("truncated").select("id").unionByName(short.select("id")).distinct()
    return looked.select("id", F.explode("defects").alias("defect")).unionByName(cuts.select("id", F.lit("truncated").alias("defect")))
