"""A stream that is stopped and restarted gives the table of one run; transient failures are asked for again."""

import uuid

from reviewlane.functions.materialize import shared_folder
from reviewlane.streaming import ingest

ENTRY = "id long, sha string, reason string, seen long"
WAVES = [
    [(1, "a", None, 0), (2, None, "TIMEOUT", 0), (3, None, "NOT_FOUND", 0), (4, None, "THROTTLED", 0), (None, "x", None, 0)],
    [(2, "b", None, 1), (4, None, "HTTP_ERROR", 1), (5, "e", None, 1)],
    [(1, None, "TIMEOUT", 2), (4, None, "TIMEOUT", 2), (5, "e2", None, 2)],
]
WANT = {(1, "a", None, 0), (2, "b", None, 1), (3, None, "NOT_FOUND", 0), (4, None, "TIMEOUT", 2), (5, "e2", None, 2)}


def test_restarts_and_one_run_agree(spark):
    def folder():
        return f"{shared_folder(spark)}/fetched/{uuid.uuid4().hex}"

    def arrive(at, rows):
        spark.createDataFrame(rows, ENTRY).write.mode("append").parquet(f"{at}/in")

    resumed, once = folder(), folder()
    for rows in WAVES:
        arrive(resumed, rows)
        ingest.ingest(spark, f"{resumed}/in", resumed, ENTRY, files=1)
        arrive(once, rows)
    batches = spark.read.parquet(f"{resumed}/entries").count()
    ingest.ingest(spark, f"{resumed}/in", resumed, ENTRY)  # nothing is new
    assert spark.read.parquet(f"{resumed}/entries").count() == batches == sum(map(len, WAVES))
    ingest.ingest(spark, f"{once}/in", once, ENTRY)
    for at in (resumed, once):
        held = ingest.current(spark, at, ENTRY, "id")
        got = {tuple(r) for r in held.collect()}
        assert got == WANT
        asked = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
        assert {r.id for r in ingest.to_request(asked, held, "id").collect()} == {4, 6, 7}


def test_a_repeated_batch_replaces_itself(spark):
    at = f"{shared_folder(spark)}/fetched/{uuid.uuid4().hex}"
    rows = spark.createDataFrame(WAVES[0], ENTRY)
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{at}/entries/batch=000000000")
    assert ingest.current(spark, at, ENTRY, "id").count() == 4
