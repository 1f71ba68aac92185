"""City dimension (S5) and city-list selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 48 monitored cities as (city, lat, lon, region), in the
# configured order.  The position in this list is the city's index ``ix``.
CITIES = [
    ("Chandigarh", 30.7333, 76.7794, "North"),
    ("Shimla", 31.1048, 77.1734, "North"),
    ("Dehradun", 30.3165, 78.0322, "North"),
    ("Lucknow", 26.8467, 80.9462, "North"),
    ("Amritsar", 31.6340, 74.8723, "North"),
    ("Ludhiana", 30.9010, 75.8573, "North"),
    ("Jammu", 32.7266, 74.8570, "North"),
    ("Delhi", 28.6139, 77.2090, "NCR"),
    ("Gurugram", 28.4595, 77.0266, "NCR"),
    ("Noida", 28.5355, 77.3910, "NCR"),
    ("Faridabad", 28.4089, 77.3178, "NCR"),
    ("Ghaziabad", 28.6692, 77.4538, "NCR"),
    ("Greater Noida", 28.4744, 77.5040, "NCR"),
    ("Gandhinagar", 23.2156, 72.6369, "West"),
    ("Mumbai", 19.0760, 72.8777, "West"),
    ("Panaji", 15.4909, 73.8278, "West"),
    ("Ahmedabad", 23.0225, 72.5714, "West"),
    ("Pune", 18.5204, 73.8567, "West"),
    ("Surat", 21.1702, 72.8311, "West"),
    ("Vadodara", 22.3072, 73.1812, "West"),
    ("Amaravati", 16.5412, 80.5154, "South"),
    ("Bengaluru", 12.9716, 77.5946, "South"),
    ("Thiruvananthapuram", 8.5241, 76.9366, "South"),
    ("Chennai", 13.0827, 80.2707, "South"),
    ("Hyderabad", 17.3850, 78.4867, "South"),
    ("Kochi", 9.9312, 76.2673, "South"),
    ("Coimbatore", 11.0168, 76.9558, "South"),
    ("Visakhapatnam", 17.6868, 83.2185, "South"),
    ("Bhopal", 23.2599, 77.4126, "Central"),
    ("Raipur", 21.2444, 81.6306, "Central"),
    ("Indore", 22.7196, 75.8577, "Central"),
    ("Nagpur", 21.1458, 79.0882, "Central"),
    ("Patna", 25.5941, 85.1376, "East"),
    ("Ranchi", 23.3600, 85.3300, "East"),
    ("Bhubaneswar", 20.2961, 85.8245, "East"),
    ("Kolkata", 22.5726, 88.3639, "East"),
    ("Dhanbad", 23.7957, 86.4304, "East"),
    ("Siliguri", 26.7271, 88.3953, "East"),
    ("Itanagar", 27.1004, 93.6166, "Northeast"),
    ("Dispur", 26.1445, 91.7362, "Northeast"),
    ("Imphal", 24.8170, 93.9368, "Northeast"),
    ("Shillong", 25.5788, 91.8933, "Northeast"),
    ("Aizawl", 23.7271, 92.7176, "Northeast"),
    ("Kohima", 25.6701, 94.1077, "Northeast"),
    ("Gangtok", 27.3389, 88.6065, "Northeast"),
    ("Agartala", 23.8315, 91.2868, "Northeast"),
    ("Guwahati", 26.1445, 91.7362, "Northeast"),
    ("Leh", 34.1526, 77.5771, "UT"),
]


def dim_city(spark: SparkSession, with_index: bool = False) -> DataFrame:
    """The 48-row city dimension (city, lat, lon, region[, ix]).

    A literal table, so the planner knows its size and broadcasts it without
    a hint.
    """
    return spark.sql(
        "SELECT city, cast(lat AS double) AS lat, cast(lon AS double) AS lon, region"
        + (", cast(ix AS bigint) AS ix" if with_index else "") + f" FROM {dim_city_sql_values()}")


def dim_city_sql_values() -> str:
    """The same dimension as a SQL ``VALUES`` list (for the DuckDB oracle)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    rows = ",\n    ".join(
        f"({i}, {q(c)}, {lat!r}, {lon!r}, {q(r)})"
        for i, (c, lat, lon, r) in enumerate(CITIES))
    return f"(VALUES\n    {rows}\n) AS dim_city(ix, city, lat, lon, region)"


CITY_NAMES = tuple(c for c, *_rest in CITIES)


def select_cities(feed: DataFrame, cities=CITY_NAMES) -> DataFrame:
    """Only rows of the listed cities (a job argument; the fixed list by
    default).  On a landing scan ``city`` is a partition column, so this
    prunes unlisted cities' folders at listing time (no file of theirs is
    opened).  A NULL city is not listed."""
    return feed.where(F.col("city").isin(*cities))
