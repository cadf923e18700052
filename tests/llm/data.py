"""Small transcripts with the cases that every operator must survive."""

import random

WORDS = ["clip", "hook", "intro", "story", "guest", "camera", "edit", "sound", "frame", "topic", "scene", "title", "upload", "channel"]


def prose(seed, n):
    dealt = random.Random(seed)
    return " ".join(dealt.choice(WORDS) + str(dealt.randrange(50)) for _ in range(n))


LONG = prose(99, 30_000)

#: video_id, transcript, source_key, language: nulls, empties, a long text, repeated rows, one id with two texts.
ROWS = [
    (1, prose(1, 60), "a", "en"), (2, prose(1, 60), "a", "en"), (2, prose(1, 60), "a", "en"), (3, None, "b", None), (4, "", "b", "en"),
    (5, " \n\t ", None, "en"), (None, prose(2, 40), None, "de"), (6, LONG, "c", "en"), (7, prose(3, 30), "a", "fr"), (7, prose(4, 30), "c", None),
    (8, "one two", "", "en"), (9, "One\ttwo", "", "en"), (10, "ÄÖ ü ß 12", "b", "de"), (None, None, None, None),
]
SHAPE = "video_id long, transcript string, source_key string, language string"


def table(spark, rows=ROWS):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["score", "shard", "slot", "n_words", "spans", "items", "_id", "_text", "_part", "_key", "line", "token", "set_id", "bits", "toxic"]
    return spark.createDataFrame(rows, SHAPE).select("*", *[F.lit("x").alias(c) for c in extra])
