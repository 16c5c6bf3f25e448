"""Settings that the library's queries need of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Spark 4.1 lets a union pass on the partitioning of its sides.  Adaptive execution may then coalesce or localise the shuffle of one side alone, and what groups or joins the union by that key
# without a further shuffle sees the rows of one key in two places: groups come twice, joins lose rows.  Off, the union is shuffled again where its partitioning is needed.
#
# A plan's estimate counts one row for each source row, whatever is exploded from it, so tables of millions of rows were broadcast through the driver.  Sides are broadcast by their measured size
# only, which adaptive execution knows after their shuffle; fixed rule tables carry a hint.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with these settings; call it once where operators are used without the registered queries."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
