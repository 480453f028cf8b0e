"""Slowest stages of a Spark event log (as written with ``BENCH_EVENT_LOG``).

    python scripts/stage_times.py <event log folder> [top]
"""

import io
import json
import os
import sys


def events(path):
    """Every event of every log under ``path`` (plain files or rolling v2 folders)."""
    for root, _, files in os.walk(path):
        for name in sorted(files):
            if not (name.startswith("events_") or name.startswith("local-") or name.startswith("app-")):
                continue
            with open(os.path.join(root, name), "rb") as raw:
                if name.endswith(".zstd"):  # Spark's default event log codec
                    import zstandard
                    raw = zstandard.ZstdDecompressor().stream_reader(raw)
                for line in io.TextIOWrapper(raw, encoding="utf-8"):
                    if line.strip():
                        yield json.loads(line)


def main():
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages = []
    for e in events(path):
        if e.get("Event") == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            ms = i.get("Completion Time", 0) - i.get("Submission Time", 0)
            stages.append((ms, i["Stage ID"], i["Number of Tasks"], i["Stage Name"][:70]))
    for ms, sid, tasks, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms:8d} ms  stage {sid:4d}  {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
