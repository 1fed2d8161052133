"""A command line on a store: python -m logloom STORE set KEY VALUE | get KEY | del KEY..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="logloom")
    parser.add_argument("store", help="the folder of the store")
    parser.add_argument("--config", help="a TOML file of settings")
    parser.add_argument("--events", action="store_true", help="write what the store does to standard error, as JSON")
    actions = parser.add_subparsers(dest="action", required=True)
    for name, words in (("set", ["key", "value"]), ("get", ["key"]), ("del", ["keys"])):
        sub = actions.add_parser(name)
        for w in words:
            sub.add_argument(w, **({"nargs": "+"} if w == "keys" else {}))
    given = parser.parse_args(args)

    from logloom import config, telemetry
    from logloom.api import KeyedLog
    from logloom.functions.resp import render
    from logloom.session import get_session

    if given.events:
        telemetry.start(stream=sys.stderr)
    spark = get_session()
    with KeyedLog.open(spark, given.store, config.load(given.config).storage) as store:
        if given.action == "set":
            store.set(given.key.encode(), given.value.encode())
            reply = ("simple", None, b"OK")
        elif given.action == "get":
            value = store.get(given.key.encode())
            reply = ("null", None, None) if value is None else ("bulk", None, value)
        else:
            reply = ("integer", store.delete(*[k.encode() for k in given.keys]), None)
    row = spark.createDataFrame([reply], "kind string, i bigint, b binary")
    return row.select(render(F.col("kind"), F.col("i"), F.col("b"))).first()[0]


def run() -> None:
    print(main())


if __name__ == "__main__":
    run()
