"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.01"
PROSE = "the of and to in that it was for on are with as his they be at one have this from by hot word but what some we can out other were all there when up use your how said an each she".split()

# The columns after n_chars clash with names the operators use inside.
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hits int, part int, doc string, copy int, place long, rank int, text_hash long"


def awkward_documents(spark: SparkSession) -> DataFrame:
    rng = random.Random(3)
    prose = [" ".join(rng.choice(PROSE) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(prose)]
    rows += [
        (10, None, "en", "src0", None),
        (11, "", "en", "src0", 0),
        (12, " \t\n\r ", None, None, 4),
        (13, prose[0], None, "src1", None),  # a copy
        (14, prose[0].upper() + " more", "en", None, 1),
        (None, prose[1], "en", "src1", 1),
        (None, None, None, None, None),
        (15, "word", "en", "src0", 4),
        (16, "word", "en", "src0", 4),
        (17, "12345 67890 ???", "en", "src0", 15),
        (18, "x" * 300_000, "en", "src0", 300_000),  # one very long word
        (19, (prose[2] + "\n") * 500, "en", "src1", 1),  # very long
        (3, prose[3], "en", "src1", len(prose[3])),  # a repeated row
        (20, "naïve café   \u0000 \U0001f600 ça", "fr", "src0", 9),
    ]
    extra = ("s", 7, 8, "d", 9, 10, 11, 12)
    return spark.createDataFrame([(*r, *extra) for r in rows], DOC_SCHEMA).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)
