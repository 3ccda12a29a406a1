"""Five verbs on a store: put, get, delete, scan, flush.

python -m tidelog PATH put KEY VALUE | get KEY | delete KEY | scan START END | flush
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .sources.store import KVStore

ARGUMENTS = {"put": ("key", "value"), "get": ("key",), "delete": ("key",), "scan": ("start", "end"), "flush": ()}


def run(store: KVStore, verb: str, args: list[str], out) -> None:
    given = [a.encode() for a in args]
    if verb == "put":
        store.put(given[0], given[1])
        print("OK", file=out)
    elif verb == "get":
        value = store.get(given[0])
        print("(not found)" if value is None else value.decode(errors="replace"), file=out)
    elif verb == "delete":
        store.delete(given[0])
        print("OK", file=out)
    elif verb == "scan":
        for row in store.scan(given[0], given[1]).toLocalIterator():
            print(f"{bytes(row['key']).decode(errors='replace')} = {bytes(row['value']).decode(errors='replace')}", file=out)
    else:
        store.flush()
        print("flushed", file=out)


def main(argv: list[str], spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    if len(argv) < 2:
        print(__doc__, file=err)
        return 1
    path, verb, *args = argv
    if verb not in ARGUMENTS:
        print(f"unknown command: {verb}", file=err)
        return 1
    if len(args) < len(ARGUMENTS[verb]):
        print(" ".join((verb, *(f"<{a}>" for a in ARGUMENTS[verb]))), file=err)
        return 1
    spark = spark or SparkSession.builder.appName("tidelog").getOrCreate()
    with KVStore(spark, path) as store:
        run(store, verb, args, out)
    return 0
