"""``python -m postloom POSTS TARGET AS_OF``: runs the pipeline over a Parquet table of posts."""

import sys

from postloom.plans import pipeline
from postloom.session import local_session, ship
from postloom.sources import tables as tb

if __name__ == "__main__":
    if len(sys.argv) != 4:
        sys.exit(__doc__)
    spark = ship(local_session())
    from pyspark.sql import functions as F

    posts = tb.keep_first(spark.read.parquet(sys.argv[1]), ["id"], F.col("updated_at").desc_nulls_last(), F.col("hash").asc())
    pipeline.run(spark, posts, sys.argv[2], sys.argv[3])
