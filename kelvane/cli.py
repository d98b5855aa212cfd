"""python -m kelvane.cli DIR add KEY VALUE | get KEY | rm KEY | list | merge | sql QUERY"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .model import KeyOrder, Options
from .plans.dialect import ParseError
from .plans.planner import format_rows
from .sources.store import Store


def main(args: list[str], spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    need = {"add": 2, "get": 1, "rm": 1, "list": 0, "merge": 0, "sql": 1}
    if len(args) < 2 or need.get(args[1]) != len(args) - 2:
        print(__doc__, file=err)
        return 2
    folder, command, *rest = args
    spark = spark or SparkSession.builder.appName("kelvane").getOrCreate()
    reads = command in ("get", "list", "sql")
    with Store.open(spark, folder, Options(KeyOrder.SORTED, read_only=reads)) as store:
        if command == "add":
            store.put(rest[0].encode(), rest[1].encode())
        elif command == "rm":
            store.delete(rest[0].encode())
        elif command == "merge":
            store.merge()
        elif command == "list":
            for r in store.list_keys().toLocalIterator():
                print(bytes(r["key"]).decode("utf-8", "replace"), file=out)
        elif command == "get":
            value = store.get(rest[0].encode())
            if value is None:
                print("key not found", file=err)
                return 1
            print(value.decode("utf-8", "replace"), file=out)
        else:
            try:
                df = store.sql(rest[0])
            except ParseError as e:
                print(f"{rest[0]}\n{' ' * e.at}^ {e.message}", file=err)
                return 1
            print(format_rows(df.collect(), df.columns), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
