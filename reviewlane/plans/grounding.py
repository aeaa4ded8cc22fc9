"""Notes written from the measurements, some of them wrong on purpose, and what the checker finds in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.operators import grounding
from reviewlane.sources.tables import candidates


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each measured row. By the row's number the megahertz, the place in time or the code are wrong, or the note is empty."""
    c = candidates(spark, sf_dir).where("prob is not null")
    hz, i = 400_000_001 + F.col("obs_id") * 10, F.col("obs_id")
    duration, closest = 300 + i % 100, (i % 11) / 10.0
    mhz = F.format_string("%.3f", (hz + F.when(i % 6 == 1, 250_000).otherwise(0)) / 1e6)
    share = F.format_string("%.0f", F.rint(F.col("prob") * 100))
    place = F.rint(closest * duration).cast("long") + F.when(i % 6 == 2, duration).otherwise(0)
    code = F.when(i % 6 == 3, "NO_SUCH_REASON").otherwise("STALE_CATALOGUE_FREQ")
    text = F.concat(F.lit("Flagged "), code, F.lit(": heard at "), mhz, F.lit(" MHz with "), share, F.lit("%. Look "), place.cast("string"), F.lit(" seconds into the pass."))
    printed = F.concat(F.lit("reasons STALE_CATALOGUE_FREQ, duration "), duration.cast("string"), F.lit(" s"))
    values = F.create_map(F.lit("downlink_hz"), hz.cast("double"), F.lit("probability"), F.col("prob"), F.lit("duration_s"), duration.cast("double"), F.lit("closest"), closest, F.lit("place_s"), place.cast("double"))
    return c.select("obs_id", F.when(i % 6 == 4, "").otherwise(text).alias("text"), printed.alias("printed"), values.alias("values"))


def note_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.violations(_notes(spark, sf_dir), "obs_id", "text", "printed", "values", ["probability"], "duration_s", "closest")


QUERIES = {"note_violations": note_violations}


def oracles(cand: str) -> dict[str, str]:
    """What was written wrong, by the number of the row; cand: the registry's common table expression of candidates."""
    return {
        "note_violations": f"""WITH {cand}, m AS (SELECT obs_id, 400000001 + obs_id * 10 AS hz, 300 + obs_id % 100 AS duration, (obs_id % 11) / 10::DOUBLE AS closest FROM cand WHERE prob IS NOT NULL)
        SELECT obs_id, 'UNGROUNDED_NUMBER' AS code, printf('%.3f', (hz + 250000) / 1e6::DOUBLE) AS literal, 'mhz' AS unit FROM m WHERE obs_id % 6 = 1
        UNION ALL SELECT obs_id, 'MISLOCATED_TIME_CLAIM', CAST(CAST(round_even(closest * duration, 0) AS BIGINT) + duration AS VARCHAR), 's' FROM m WHERE obs_id % 6 = 2
        UNION ALL SELECT obs_id, 'UNGROUNDED_ENTITY', 'NO_SUCH_REASON', '' FROM m WHERE obs_id % 6 = 3
        UNION ALL SELECT obs_id, 'EMPTY', '', '' FROM m WHERE obs_id % 6 = 4""",
    }
