"""python -m loomgraph COMMAND GRAPH [key=value ...]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from loomgraph.commands import COMMANDS, run


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(f"{__doc__}\ncommands: {', '.join(sorted(COMMANDS))}", file=sys.stderr)
        return 2
    options = dict(a.split("=", 1) for a in args[2:])
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    out = run(spark, args[0], args[1], options)
    if "out" in options:
        out.write.mode("overwrite").json(options["out"])
    else:
        for line in out.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
