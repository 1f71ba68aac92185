"""Streaming: intentionally empty.

The original job is batch only: full fetch, full file read, full file write,
with no stream, watermark, state or late data (SURVEY section 2.8).  Its only
windowing, the 6-hour tumbling bin, is a batch ``groupBy`` in
:mod:`airshed.operators.resample`.  No streaming operator is added.
"""
