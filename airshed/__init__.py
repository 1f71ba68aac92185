"""airshed: a Spark-native batch job for city air-quality series.

Landed hourly pollutant and weather payloads become 6-hour city series, are
joined on (city, time), get calendar / weather / region / season features, and
feed gradient-boosted regressors with k-fold cross-validation.

Every step is a ``DataFrame -> DataFrame`` function on the public PySpark
DataFrame / ML API, usable with ``df.transform(...)``.
"""

__all__ = ["schemas", "session", "params"]
