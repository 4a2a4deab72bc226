"""Line dedup with DataFrame functions only: hashes of lines are range-partitioned and streamed in order of document and position.

Each line's key (ASCII white space stripped at both ends, A-Z lower-cased) is hashed to 128 bits. Occurrences are
range-partitioned by (hash, slice), where a slice holds an even share of the document ids, with a slice for each SLICE_LINES
lines, so that a line that stands in a third of all documents is spread over many tasks however many there are; within a partition they are sorted by document (largest first) and position, and
the first occurrence of each slice is streamed out with the slice's number of documents. These heads, at most one a slice for
a hash, settle which document keeps the line. The result is a bitmap of the lines to keep for each document that loses any, as runs
of kept lines; texts are not part of it.

Documents without a bitmap keep all lines. Very long texts, and very many lines, are worked on whole. Null and empty texts are one empty line. Rows with a null id are neither counted
nor cut. Rows of the same id count as one document and keep or lose a line together. Columns besides the id and the text
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, texts, written

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"

#: Slices of document ids at least, and lines for each further one.
SLICES, SLICE_LINES = 64, 1 << 22


def _lines(text):
    return F.split(text, "\n")


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_runs array<struct<first int, length int>>) of the rows that lose lines.

    A line whose key has at least min_chars code points and stands in at least min_docs documents is kept in the largest id only.
    """
    t = texts(docs, id_col, text_col).where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    lines = t.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    keyed = lines.where(F.char_length("line") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("h")
    )
    keyed = written(keyed)  # hashes of lines, which the bounds of the ranges, the ranges and the join below all read
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(max(SLICES, keyed.count() // SLICE_LINES))).cast("int"))
    ranged = keyed.repartitionByRange("h", "slice").sortWithinPartitions("h", "slice", F.desc("doc_id"), "pos")
    stream = Window.partitionBy("h", "slice").orderBy(F.desc("doc_id"), "pos")
    first_in_doc = F.when(F.col("doc_id") == F.lag("doc_id").over(stream), 0).otherwise(1)
    heads = ranged.withColumn("new", first_in_doc).groupBy("h", "slice").agg(F.max("doc_id").alias("keeper"), F.sum("new").alias("n"))
    keys = heads.groupBy("h").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"), F.collect_list("slice").alias("slices")).where(F.col("n") >= min_docs)
    dropped = keyed.join(keys.select("h", F.explode("slices").alias("slice"), "keeper"), ["h", "slice"]).where("doc_id <> keeper")
    gone = dropped.select("doc_id", "text_hash", "pos").distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    # A run of kept lines lies between a dropped line and the next; the last run is open (length -1: to the end).
    first = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    length = F.concat(F.transform("gone", lambda p, i: p - F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1) + 1)), F.array(F.lit(-1)))
    runs = F.filter(F.arrays_zip(first.alias("first"), length.alias("length")), lambda r: r["length"] != 0)
    return gone.select("doc_id", "text_hash", F.size("gone").cast("long").alias("n_dropped"), runs.alias("keep_runs"))


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the text cut to its kept lines; `counts` names columns for the numbers of lines before, and of dropped ones. A null text becomes the empty one."""
    own = {c: free_name(docs, f"__{c}") for c in ("id", "hash", "n", "runs", "lines", "of")}
    b = bitmaps.select(F.col("doc_id").alias(own["id"]), F.col("text_hash").alias(own["hash"]), F.col("n_dropped").alias(own["n"]), F.col("keep_runs").alias(own["runs"]))
    whole = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(own["of"], F.xxhash64(text_col))
    joined = whole.join(b, (F.col(id_col).cast("long") == F.col(own["id"])) & (F.col(own["of"]) == F.col(own["hash"])), "left")
    lined = joined.withColumn(own["lines"], _lines(F.col(text_col)))
    lines, runs = F.col(own["lines"]), F.col(own["runs"])
    kept = F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, F.when(r["length"] < 0, F.size(lines) - r["first"]).otherwise(r["length"]))))
    text = F.when(runs.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    numbers = [F.size(lines).cast("long").alias(counts[0]), F.coalesce(own["n"], F.lit(0).cast("long")).alias(counts[1])] if counts else []
    return lined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *numbers)
