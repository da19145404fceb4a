"""Session settings the plans are written for."""

#: Set by a caller whose tables are single unsplittable files: partitions that heavy inputs are dealt out to. Unset on a
#: cluster, where the scan has splits enough.
SCAN_PARTITIONS = "spark.caretide.scanPartitions"

CONF = {
    # runtime re-planning: partition sizes, skewed joins and writes
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # the JVM never compiles a method over 8000 bytecodes; past that, split expressions run faster than one
    # huge generated method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder):
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return builder
