import json
import os

import pytest
from pyspark.errors import AnalysisException

from airshed import schemas
from airshed.sources.files import empty_like, read_csv, write_csv
from airshed.sources.payload import hourly_from_landing
from tests.conftest import ts

GOOD = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T07:00"],
                   "pm10": [10.0, None, 30.0], "pm2_5": [1.0, 2.0, 3.0]}}


def land(base, payloads: dict[str, list[str]]):
    """Write one JSON text per line under <base>/feed=aqi/city=<name>/."""
    root = os.path.join(base, "feed=aqi")
    for city, texts in payloads.items():
        d = os.path.join(root, f"city={city}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "part-0.json"), "w") as f:
            f.write("\n".join(texts) + "\n")
    return root


@pytest.mark.parametrize("bad,reason", [
    ('{"error": true}', "no_hourly"),
    ('{"hourly": {"time": ["2024-01-01T00:00"], "pm10": [1.0], "pm2_5"', "corrupt"),
    ('{"hourly": {"time": [], "pm10": [], "pm2_5": []}}', "empty"),
    ('{"hourly": {"time": ["2024-01-01T00:00"], "pm10": [1.0, 2.0], "pm2_5": [1.0]}}', "length_mismatch"),
    ('{"hourly": {"time": ["yesterday"], "pm10": [1.0], "pm2_5": [1.0]}}', "bad_time"),
    ('{"hourly": {"time": ["2024-01-01T00:00"], "pm10": [1.0]}}', "missing_variable"),
])
def test_reject_kinds_drop_only_that_city(spark, tmp_dir, bad, reason):
    root = land(tmp_dir, {"Delhi": [json.dumps(GOOD)],
                          "Greater Noida": [json.dumps(GOOD), bad]})
    rows, rej = hourly_from_landing(spark, root, "aqi")
    assert [tuple(r) for r in rej.collect()] == [("aqi", "Greater Noida", reason)]
    got = rows.collect()
    assert {r.city for r in got} == {"Delhi"}
    assert len(got) == 3
    assert [r.time for r in sorted(got)][0] == ts("2024-01-01 00:00:00")


def test_space_time_format_and_nan(spark, tmp_dir):
    p = {"hourly": {"time": ["2024-01-01 00:00:00"], "pm10": [float("nan")], "pm2_5": [1.0]}}
    root = land(tmp_dir, {"Leh": [json.dumps(p)]})
    rows, rej = hourly_from_landing(spark, root, "aqi")
    r = rows.first()
    assert rej.count() == 0
    assert r.time == ts("2024-01-01 00:00:00") and r.pm10 is None and r.city == "Leh"


def test_all_rejected_gives_empty_table_with_schema(spark, tmp_dir):
    from airshed.plans.stages import gather_aqi
    root = land(tmp_dir, {"Delhi": ['{"error": 1}']})
    rows, rej = hourly_from_landing(spark, root, "aqi")
    out = gather_aqi(rows)
    assert out.count() == 0 and out.columns == ["time", "city", "pm10", "pm2_5"]
    e = empty_like(spark, schemas.RAW_AQI)
    assert e.count() == 0 and e.schema == schemas.RAW_AQI


def test_csv_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(ts("2024-01-01 06:00:00"), "A", 1.5, None)], schemas.RAW_AQI)
    path = os.path.join(tmp_dir, "csv")
    write_csv(df, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert "time,city,pm10,pm2_5" in text and "2024-01-01 06:00:00,A,1.5," in text
    back = read_csv(spark, path, schemas.RAW_AQI).collect()
    assert [tuple(r) for r in back] == [(ts("2024-01-01 06:00:00"), "A", 1.5, None)]


def test_missing_input_raises(spark, tmp_dir):
    from airshed.sources.files import read_stage
    with pytest.raises(AnalysisException):
        read_stage(spark, os.path.join(tmp_dir, "nope")).count()


def test_multiline_payload_files(spark, tmp_dir):
    from airshed.sources.payload import read_payloads
    root = os.path.join(tmp_dir, "feed=aqi")
    for city in ("Delhi", "Pune"):
        d = os.path.join(root, f"city={city}")
        os.makedirs(d)
        with open(os.path.join(d, "payload.json"), "w") as f:
            json.dump(GOOD, f, indent=2)  # one pretty-printed object per file
    payloads = read_payloads(spark, root, ["pm10", "pm2_5"], multiline=True)
    rows, rej = hourly_from_landing(spark, root, "aqi", payloads=payloads)
    assert rej.count() == 0
    assert sorted((r.city, r.time.hour) for r in rows.collect()) == \
        [("Delhi", 0), ("Delhi", 1), ("Delhi", 7), ("Pune", 0), ("Pune", 1), ("Pune", 7)]


def test_date_range_is_inclusive_of_end_day(spark):
    import datetime as dt

    from airshed.sources.payload import restrict_dates
    times = ["2024-01-31 23:59:59", "2024-02-01 00:00:00", "2024-02-29 23:00:00", "2024-03-01 00:00:00"]
    df = spark.createDataFrame([(ts(t),) for t in times], "time timestamp_ntz")
    got = [r.time for r in restrict_dates(df, dt.date(2024, 2, 1), dt.date(2024, 2, 29)).orderBy("time").collect()]
    assert got == [ts("2024-02-01 00:00:00"), ts("2024-02-29 23:00:00")]


def test_service_shaped_weather_payload(spark, tmp_dir):
    """Extra top-level fields are ignored; integer JSON numbers read as double."""
    from airshed.sources.payload import read_payloads
    payload = {
        "latitude": 28.625, "longitude": 77.25, "generationtime_ms": 0.12,
        "utc_offset_seconds": 19800, "timezone": "Asia/Kolkata", "elevation": 216.0,
        "hourly_units": {"time": "iso8601", "temperature_2m": "°C"},
        "hourly": {
            "time": ["2024-05-01T00:00", "2024-05-01T01:00"],
            "temperature_2m": [31.5, 30], "relative_humidity_2m": [41, 45],
            "wind_speed_10m": [7.2, 6.8], "wind_direction_10m": [290, 300],
            "precipitation": [0, 0.1], "surface_pressure": [976.4, 976.9],
        },
    }
    root = os.path.join(tmp_dir, "feed=weather")
    d = os.path.join(root, "city=Delhi")
    os.makedirs(d)
    with open(os.path.join(d, "p.json"), "w") as f:
        json.dump(payload, f, indent=2, ensure_ascii=False)
    payloads = read_payloads(spark, root, schemas.WEATHER_VARS, multiline=True)
    rows, rej = hourly_from_landing(spark, root, "weather", payloads=payloads)
    assert rej.count() == 0
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [(ts("2024-05-01 00:00:00"), "Delhi", 31.5, 41.0, 7.2, 290.0, 0.0, 976.4),
                   (ts("2024-05-01 01:00:00"), "Delhi", 30.0, 45.0, 6.8, 300.0, 0.1, 976.9)]


def test_null_city_is_a_city_like_any_other(spark, tmp_dir):
    """Rows of a city without a name stay, with or without rejects elsewhere, and go when it is rejected."""
    good = json.dumps(GOOD)
    nameless = "__HIVE_DEFAULT_PARTITION__"
    for i, (payloads, want) in enumerate([
            ({nameless: [good], "Leh": [good]}, {None, "Leh"}),
            ({nameless: [good], "Leh": ['{"error": 1}']}, {None}),
            ({nameless: [good, '{"error": 1}'], "Leh": [good]}, {"Leh"})]):
        root = land(os.path.join(tmp_dir, str(i)), payloads)
        rows, _ = hourly_from_landing(spark, root, "aqi")
        assert {r.city for r in rows.collect()} == want


def test_city_with_two_reasons_has_two_reject_rows(spark, tmp_dir):
    root = land(tmp_dir, {"Delhi": [json.dumps(GOOD)], "Leh": ['{"error": 1}', "{broken", '{"error": 2}']})
    rows, rej = hourly_from_landing(spark, root, "aqi")
    assert {r.city for r in rows.collect()} == {"Delhi"}
    assert sorted((r.city, r.reason) for r in rej.collect()) == [("Leh", "corrupt"), ("Leh", "no_hourly")]


def test_every_missing_city_is_named(spark):
    from airshed.operators.region import RegionMappingError, add_region
    from airshed.sources.cities import dim_city
    names = [f"Nowhere {i:03d}" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in [*names, "Leh", None]], "city string")
    with pytest.raises(RegionMappingError) as e:
        add_region(df, dim_city(spark))
    assert all(n in str(e.value) for n in names) and "None" in str(e.value) and "Leh" not in str(e.value)


def test_scratch_tables_can_be_removed(spark):
    from airshed.session import clear_scratch, pinned
    df = pinned(spark, spark.range(5), "five")
    assert df.count() == 5
    path = df.inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


def test_manifest_opens_only_the_files_that_a_range_needs(spark, tmp_dir):
    """Files by month, one bad payload, one file landed after the manifest: same result, fewer files."""
    import datetime as dt
    import json
    import os

    from airshed.params import GatherParams
    from airshed.plans import jobs
    from airshed.sources import payload as P

    def land(city, month, text=None):
        folder = f"{tmp_dir}/landing/feed=aqi/city={city}"
        os.makedirs(folder, exist_ok=True)
        hours = [f"2024-{month:02d}-{d:02d}T{h:02d}:00" for d in (1, 15) for h in range(24)]
        with open(f"{folder}/{month}.json", "w") as f:
            f.write(text or json.dumps({"hourly": {"time": hours, "pm10": [float(month)] * 48, "pm2_5": [1.0] * 48}}))

    for city in ("Delhi", "New Town", "Pune"):
        for month in range(1, 7):
            land(city, month, "not json" if (city, month) == ("Pune", 6) else None)
    path, landing, gp = f"{tmp_dir}/landing/feed=aqi", f"{tmp_dir}/landing", GatherParams(
        dt.date(2024, 2, 10), dt.date(2024, 3, 31), ("Delhi", "New Town", "Pune"))
    jobs.gather(spark, landing, f"{tmp_dir}/all", "aqi", gp)
    jobs.index(spark, landing, "aqi")
    jobs.index(spark, landing, "aqi")                       # nothing new: nothing added
    known = spark.read.parquet(f"{landing}/manifest_aqi")
    assert known.count() == 18 and known.agg({"rows": "sum"}).first()[0] == 17 * 48
    picked = P.files_for(spark, path, f"{landing}/manifest_aqi", gp.start_date, gp.end_date)
    names = sorted("/".join(f.split("city=")[1].split("/")) for f in picked)
    assert names == sorted([f"{c}/{m}.json" for c in ("Delhi", "New Town", "Pune") for m in (2, 3)] + ["Pune/6.json"])
    jobs.gather(spark, landing, f"{tmp_dir}/some", "aqi", gp)

    def rows(where, stage):
        return sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/{where}/{stage}").collect()), key=str)

    for stage in ("raw_aqi", "rejects_aqi"):
        assert rows("all", stage) == rows("some", stage)
    assert len(rows("some", "hourly_aqi")) < len(rows("all", "hourly_aqi"))   # hours parsed
    land("Delhi", 7, json.dumps({"hourly": {"time": ["2024-03-05T03:00"], "pm10": [90.0], "pm2_5": [9.0]}}))
    jobs.gather(spark, landing, f"{tmp_dir}/late", "aqi", gp)                 # unknown files are always opened
    assert len(rows("late", "raw_aqi")) == len(rows("some", "raw_aqi")) + 1
    assert P.files_for(spark, path, f"{landing}/manifest_aqi", dt.date(2030, 1, 1), dt.date(2030, 1, 2))[-1].endswith("6.json")
    jobs.index(spark, landing, "aqi")
    empty = GatherParams(dt.date(2031, 1, 1), dt.date(2031, 1, 2), ("Delhi",))
    assert jobs.gather(spark, landing, f"{tmp_dir}/none", "aqi", empty) == 0
