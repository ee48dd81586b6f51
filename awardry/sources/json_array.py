"""Files that are one JSON array of objects each, read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import running, slotted
from ..working import stored
from .cases import with_order


def read_json_array(spark: SparkSession, path: str, schema: str, slots: int | None = None) -> DataFrame:
    """The objects of the arrays with ord, their place in file order, from 0.

    A file is read in splits as pieces that end with a closing brace. Whether a piece begins inside a string follows from the
    quotes before it, and how deep it ends from the brackets outside strings; both are running sums over slots of pieces. An
    object ends where the depth falls to the array's, and its pieces are put together and parsed: a task holds some
    pieces and one object, and never a file. An object that doesn't parse has null fields.
    """
    pieces = with_order(spark.read.option("lineSep", "}").text(path), file="__file")
    last = pieces.groupBy("__file").agg(F.max("ord").alias("__last"))  # a row for each file
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes; a brace is never escaped
    pieces = pieces.join(F.broadcast(last), "__file").withColumn("__plain", plain)
    pieces = slotted(pieces.withColumn("__quotes", F.char_length(F.regexp_replace("__plain", '[^"]', ""))), [], ["ord"], slots)
    rows = running(pieces, ["__file"], ["ord"], __upto=("sum", F.col("__quotes")))
    begins = (F.col("__upto") - F.col("__quotes")) % 2  # 1: inside a string
    outside = F.array_join(F.filter(F.split("__plain", '"'), lambda x, i: (i + begins) % 2 == 0), "")
    closes = (F.col("__upto") % 2 == 0) & (F.col("ord") < F.col("__last"))  # the brace at the piece's end, which the reader takes off
    size = lambda c: F.char_length(F.regexp_replace(outside, f"[^{c}]", ""))
    rows = rows.withColumn("__depth", size(r"\[{") - size(r"\]}") - F.when(closes, 1).otherwise(0)).withColumn("__closes", closes)
    rows = running(rows.drop("__upto", "__quotes", "__plain"), ["__file"], ["ord"], __deep=("sum", F.col("__depth")))
    ends = F.when(F.col("__closes") & (F.col("__deep") == 1), 1).otherwise(0)
    rows = running(rows.withColumn("__ends", ends), [], ["ord"], __done=("sum", F.col("__ends")))
    rows = rows.where(F.col("ord") < F.col("__last")).select("ord", "value", "__ends", (F.col("__done") - F.col("__ends")).alias("__object"))
    objects = rows.groupBy("__object").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("p"), F.max("__ends").alias("whole")).where("whole = 1")
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[\[,\s\uFEFF]+", "")  # what stands before an object
    return stored(objects.select(F.from_json(text, schema).alias("r"), F.col("__object").alias("ord")), "json_array").select("r.*", "ord")
