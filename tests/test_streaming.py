"""Streaming clean step equals the batch clean step."""

import os
import tempfile

from data_dirs import SF_SMALL
from pyspark.sql import functions as F

from prevalens.config import FIXTURE_SURVEY
from prevalens.plans import clean
from prevalens.sources.fixture import survey_view
from prevalens.streaming.national import national_stream


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="prevalens-stream-")
    src = os.path.join(base, "src")
    view = survey_view(spark, SF_SMALL)
    years = sorted(r[0] for r in view.select("YearStart").distinct().collect())
    # two files per reporting period: a period split over batches must add up
    for half in (0, 1):
        for y in years:
            part = view.where((view.YearStart == y) & (F.crc32(view.LocationDesc) % 2 == half))
            part.coalesce(1).write.parquet(os.path.join(src, f"{half}-{y}"))
    q = national_stream(spark, src + "/*", view.schema, FIXTURE_SURVEY, os.path.join(base, "out"),
                        os.path.join(base, "ckpt"), min_sample=2.0)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(base, "out", "habit_national"))
    want = clean.clean_tables(view, FIXTURE_SURVEY, min_sample=2.0, validate=False)["habit_national"]
    cols = sorted(want.columns)
    g = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
               for r in got.select(*cols).collect())
    w = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
               for r in want.select(*cols).collect())
    assert g == w and len(g) > 0
