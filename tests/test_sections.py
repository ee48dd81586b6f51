"""Section names beside letters with accents."""

from pyspark.sql import functions as F

from awardry.operators.ingest import section_in_text


def test_sections_beside_accents(spark):
    texts = [(0, "un èchest de"), (1, "óarm"), (2, "a chest"), (3, "Hipß"), (4, "soft tißue"), (5, "hand_s"), (6, "x " * 249 + "knees"), (7, "Armı ſpine")]
    got = spark.createDataFrame(texts, "i int, t string").select("i", section_in_text(F.col("t"), ascii_words=True).alias("s"), section_in_text(F.col("t")).alias("u")).collect()
    assert {r.i: r.s for r in got} == {0: "CHEST", 1: "ARM", 2: "CHEST", 3: "HIP", 4: None, 5: None, 6: None, 7: "SPINE"}
    assert {r.i: r.u for r in got}[1] is None and {r.i: r.u for r in got}[2] == "CHEST"
