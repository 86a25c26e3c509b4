"""Session settings the wide budget tables run best with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a generated method above 8000 bytes is never compiled by the JVM: with projections of
    # a hundred columns, plain operators are faster than such a fused stage
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # staged tables go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # call sites per expression cost a round trip each while plans are built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def compiled_methods(df: DataFrame) -> DataFrame:
    """``df``, in a session that runs no generated method too large for the JVM to compile.

    Wide tables fuse into methods above that limit, which then run interpreted, several times
    slower. Sessions not made by ``configured`` get this one setting when a wide plan is built.
    """
    limit, conf = "spark.sql.codegen.hugeMethodLimit", df.sparkSession.conf
    if int(conf.get(limit)) > int(SETTINGS[limit]):
        conf.set(limit, SETTINGS[limit])
    return df
