"""Summarise a Spark event log: jobs and stages with their durations.

Usage: python tools/stage_times.py <event-log folder or file> [--top N]

Reads plain or zstd-compressed event logs (rolling ``eventlog_v2_*`` folders
included); no Spark UI or history server is involved.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = []
    if os.path.isdir(path):
        files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) or \
            sorted(p for p in glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isfile(p))
    else:
        files = [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd") or raw[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            if line.strip().startswith("{"):
                yield json.loads(line)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[sys.argv.index("--top") + 1]) if "--top" in sys.argv else 15
    jobs, stages = {}, {}
    for e in _lines(path):
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": len(e["Stage IDs"])}
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = {
                "name": si["Stage Name"][:60], "tasks": si["Number of Tasks"],
                "ms": si.get("Completion Time", 0) - si.get("Submission Time", 0)}
    total = sum(j.get("end", j["start"]) - j["start"] for j in jobs.values())
    print(f"jobs: {len(jobs)}  stages: {len(stages)}  summed job time: {total} ms")
    print("slowest stages:")
    for sid, s in sorted(stages.items(), key=lambda kv: -kv[1]["ms"])[:top]:
        print(f"  stage {sid:5d}  {s['ms']:7d} ms  tasks {s['tasks']:5d}  {s['name']}")


if __name__ == "__main__":
    main()
