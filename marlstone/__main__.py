"""``python -m marlstone search|train``: a search from a file, or a categoriser from sample texts."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marlstone")
    commands = parser.add_subparsers(dest="action", required=True)
    search = commands.add_parser("search", help="perform a search that a file holds, and print the result")
    search.add_argument("--datadir", "-d", required=True)
    search.add_argument("--dbname", "-n", required=True)
    search.add_argument("--searchfile", "-f", default="-", help="a path, or - for standard input")
    search.add_argument("--type", default="default")
    train = commands.add_parser("train", help="print a categoriser made from files named text_<label>")
    train.add_argument("--datadir", "-d", required=True)
    train.add_argument("--lang", "-l", action="append", help="a label to train; all if none is named")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.action == "search":
        from .collection import Engine

        collection = Engine(spark, given.datadir).collection(given.dbname)
        found = collection.search(sys.stdin.read(), given.type) if given.searchfile == "-" else collection.search_file(given.searchfile, given.type)
        print(json.dumps(found.to_dict(), ensure_ascii=False, sort_keys=True, default=str))
        return
    from .operators.categorise import trained
    from .sources.connectors import samples

    texts = samples(spark, given.datadir)
    model = trained(texts.where(texts.label.isin(given.lang)) if given.lang else texts, "label", "text")
    print(json.dumps(model.to_json(), ensure_ascii=False))


if __name__ == "__main__":
    main()
