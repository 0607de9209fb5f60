"""Summarise a Spark event log: the slowest stages with task counts and
shuffle bytes.  Usage: python scripts/event_log_stages.py <event-log file or dir> [top]

Write a log with BENCH_EVENT_LOG=<scratch dir> python bench.py ...
"""

from __future__ import annotations

import json
import os
import sys


def _files(path: str):
    if not os.path.isdir(path):
        yield path
        return
    for root, _, names in os.walk(path):
        for n in sorted(names):
            if not n.startswith(".") and not n.startswith("appstatus"):
                yield os.path.join(root, n)


def _lines(fp: str):
    if fp.endswith(".zstd"):
        import io

        import zstandard
        with open(fp, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), "utf-8")
    else:
        with open(fp) as f:
            yield from f


def stages(path: str):
    for fp in _files(path):
        for line in _lines(fp):
            ev = json.loads(line)
            if ev.get("Event") != "SparkListenerStageCompleted":
                continue
            info = ev["Stage Info"]
            start, end = info.get("Submission Time"), info.get("Completion Time")
            if start is None or end is None:
                continue
            acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
            yield {"stage": info["Stage ID"], "name": info["Stage Name"][:60],
                   "ms": end - start, "tasks": info["Number of Tasks"],
                   "shuffle_read": (acc.get("internal.metrics.shuffle.read.remoteBytesRead") or 0)
                                   + (acc.get("internal.metrics.shuffle.read.localBytesRead") or 0),
                   "shuffle_write": acc.get("internal.metrics.shuffle.write.bytesWritten") or 0}


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = sorted(stages(path), key=lambda r: -r["ms"])
    total = sum(r["ms"] for r in rows)
    print(f"{len(rows)} stages, {total / 1000:.1f} s of stage time")
    for r in rows[:top]:
        print(f"{r['ms']:>7} ms  stage {r['stage']:>4}  tasks {r['tasks']:>4}  "
              f"shuffle r/w {r['shuffle_read']:>10}/{r['shuffle_write']:>10}  {r['name']}")


if __name__ == "__main__":
    main()
