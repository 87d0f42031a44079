"""Command line: create, ingest-docs, ingest-vectors, search, profile."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import profile
from .plans import engine
from .sources import ndjson
from .sources.store import Store


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="larkspur")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("create", ()), ("ingest-docs", ("path",)), ("ingest-vectors", ("path",)), ("search", ("text",))):
        s = sub.add_parser(name)
        s.add_argument("root")
        for x in extra:
            s.add_argument(x)
        if name == "search":
            s.add_argument("--top-k", type=int, default=5)
            s.add_argument("--preview", action="store_true")
    sub.add_parser("profile").add_argument("path")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "create":
        Store(spark, a.root).create()
    elif a.command == "ingest-docs":
        print(Store(spark, a.root).publish_documents(ndjson.documents(spark, a.path)))
    elif a.command == "ingest-vectors":
        print(Store(spark, a.root).publish_vectors(ndjson.read(spark, a.path, ndjson.VECTOR_SCHEMA).select("doc_id", F.col("values").alias("embedding"))))
    elif a.command == "search":
        found = engine.search(Store(spark, a.root), engine.SearchRequest("text", a.text, None, a.top_k, a.preview))
        for r in found.collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        print(json.dumps(profile.corpus_profile(ndjson.documents(spark, a.path)).first().asDict()))


if __name__ == "__main__":
    main()
