"""Player-load analytics on Spark.

Time-ordered tracking rows (position, speed) per key become accelerations,
covered distance and speed zones; acceleration events are extracted, merged,
filtered, classified and scored; marts answer the dashboard questions.

Every operator is ``DataFrame -> DataFrame`` and takes the grouping ``keys``
explicitly, so the production key ``[match_id, player_id]`` and the fixture
key ``[player_id]`` run through the same code.
"""

from pitchload.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
