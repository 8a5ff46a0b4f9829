"""Settings that the operators put on a session."""

import pyarrow as pa
from pyspark.sql import functions as F

from sluiceway.llm.runtime import BATCH, BATCH_BYTES, ship


def test_workers_get_bounded_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        ship(spark)
        long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("a"), 10_000).alias("text"))
        got = long.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
        assert got[0] == 4000
        assert got[1] <= BATCH_BYTES + 100_000
        spark.conf.set(BATCH, "1m")
        ship(spark)
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
