"""Command line: ``python -m lexiscope.cli run battery.yaml [out.json]`` and ``diff a.json b.json``."""

from __future__ import annotations

import json
import sys

from lexiscope.plans.battery import Battery, differences, payload, write_json


def main(args: list[str]) -> int:
    if args[:1] == ["run"] and len(args) in (2, 3):
        from pyspark.sql import SparkSession

        with open(args[1], encoding="utf-8") as f:
            battery = Battery.from_yaml(f.read())
        spark = SparkSession.builder.appName("lexiscope").getOrCreate()
        text = write_json(payload(battery.run(spark), {m["result"]: m["metric"] for m in battery.metrics}), args[2] if len(args) == 3 else None)
        if len(args) == 2:
            print(text)
        return 0
    if args[:1] == ["diff"] and len(args) == 3:
        loaded = []
        for path in args[1:]:
            with open(path, encoding="utf-8") as f:
                loaded.append(json.load(f))
        found = differences(*loaded)
        print("\n".join(found))
        return int(bool(found))
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
