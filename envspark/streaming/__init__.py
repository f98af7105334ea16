"""Structured Streaming entry points.

The reference is batch-only; these functions apply the SAME row operators
to observation files arriving over time, so a deployment can score new days
incrementally instead of re-running the whole batch:

* ``score_stream``: fitted index + alert flag + level (E2, E4, F1) on a
  streaming DataFrame, joined with the one-row fitted params (stream-static
  broadcast join, no state).
* ``daily_city_mean_stream``: D5 per (city, day) with a watermark so late
  rows are accepted up to a bound and state is dropped after it.
"""

from envspark.streaming.scoring import daily_city_mean_stream, score_stream  # noqa: F401
