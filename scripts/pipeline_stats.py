"""Wall time, stages, tasks and shuffle bytes of one registered query,
read from Spark's event log written to a scratch folder.

    python scripts/pipeline_stats.py <sf_dir> <query> [<query> ...]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    ev = tempfile.mkdtemp(prefix="run-evlog-")
    spark = (SparkSession.builder.master("local[8]").appName("pipeline-stats")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from margin_engine.queries import REGISTRY
    from margin_engine.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    REGISTRY["clean_keyword"](spark, sf).write.format("noop").mode("overwrite").save()  # warm
    spans = {}
    for n in names:
        t0 = time.time()
        REGISTRY[n](spark, sf).write.format("noop").mode("overwrite").save()
        spans[n] = (t0 * 1000, time.time() * 1000)
    spark.stop()
    path = glob.glob(f"{ev}/*/events_*")[0]
    text = zstandard.ZstdDecompressor().stream_reader(open(path, "rb")).read().decode()
    stages = []
    for line in text.splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
            stages.append((si["Submission Time"], si["Number of Tasks"],
                           int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                           int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                           + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0),
                           si["Completion Time"] - si["Submission Time"], si["Stage ID"],
                           si.get("Details", "").split("\n")[0][:90]))
    verbose = os.environ.get("STAGES") == "1"
    for n, (a, b) in spans.items():
        mine = [s for s in stages if a <= s[0] <= b]
        if verbose:
            for s in sorted(mine, key=lambda x: -x[4])[:12]:
                print(json.dumps({"query": n, "stage": s[5], "tasks": s[1], "ms": s[4],
                                  "name": s[6]}, ensure_ascii=False))
        print(json.dumps({"query": n, "wall_s": round((b - a) / 1000, 2), "stages": len(mine),
                          "tasks": sum(s[1] for s in mine),
                          "shuffle_write_mb": round(sum(s[2] for s in mine) / 2**20, 2),
                          "shuffle_read_mb": round(sum(s[3] for s in mine) / 2**20, 2)}))


if __name__ == "__main__":
    main()
