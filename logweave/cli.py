"""Commands: ``mkconf``, ``distance`` and ``cluster``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from logweave.functions.patterns import DEFAULT_THRESHOLD, PatternSet
from logweave.functions.text import automaton, normalised_distance, pattern_distance
from logweave.operators.cluster import cluster, cluster_preprocessed
from logweave.operators.distance import INFINITY
from logweave.operators.render import html_of
from logweave.operators.storage import release, settled
from logweave.sources.documents import json_of, stream_document
from logweave.sources.lines import from_strings, read_lines

log = logging.getLogger("logweave")


def _config(path: str | None) -> tuple[PatternSet, float]:
    if path is None:
        return PatternSet.default(), DEFAULT_THRESHOLD
    import json

    with open(path, encoding="utf-8") as file:
        text = file.read()
    return PatternSet.from_json(text), float(json.loads(text).get("threshold", DEFAULT_THRESHOLD))


def distance(a: str, b: str, patterns: PatternSet, normalized: bool = False) -> float | None:
    """Pattern distance of two strings without a session."""
    measure = normalised_distance if normalized else pattern_distance
    return measure(automaton(a, patterns), automaton(b, patterns), patterns.densities(), INFINITY)


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="logweave")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("mkconf", help="print the default configuration")
    pair = sub.add_parser("distance", help="print the pattern distance of two strings")
    pair.add_argument("-c", "--config")
    pair.add_argument("-n", "--normalized", action="store_true")
    pair.add_argument("-v", "--verbose", action="store_true")
    pair.add_argument("a")
    pair.add_argument("b")
    many = sub.add_parser("cluster", help="cluster the lines of a file")
    many.add_argument("-c", "--config")
    many.add_argument("-H", "--html-file", "--html", nargs="?", const="", metavar="FILE", help="write HTML to a file beside the JSON; without a file, instead of it")
    many.add_argument("-i", "--input-file", "--input", metavar="FILE", help="a file; standard input if left out")
    many.add_argument("-n", "--no-async", action="store_true", help="accepted for compatibility; results never depend on timing")
    many.add_argument("-o", "--output-file", "--output", metavar="FILE", help="a file; standard output if left out")
    many.add_argument("-p", "--with-preprocessing", "--preprocess", action="store_true", help="cluster one line of each class of equal automata")
    many.add_argument("-t", "--threshold", type=float)
    many.add_argument("-v", "--verbose", action="store_true")
    got = top.parse_args(args)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if getattr(got, "verbose", False) else logging.WARNING, format="[%(levelname)s] %(message)s")
    if got.command == "mkconf":
        print(PatternSet.full().to_json())
        return 0
    patterns, threshold = _config(got.config)
    if got.command == "distance":
        print(distance(got.a, got.b, patterns, got.normalized))
        return 0
    threshold = threshold if got.threshold is None else got.threshold
    log.info("threshold %s, patterns %s", threshold, patterns.names)
    spark = SparkSession.builder.getOrCreate()
    lines = read_lines(spark, got.input_file) if got.input_file else from_strings(spark, (x.strip() for x in sys.stdin))
    lines = settled(lines)
    found = settled((cluster_preprocessed if got.with_preprocessing else cluster)(lines, patterns, threshold))
    documents = {}
    if got.html_file is not None:
        documents[got.html_file or got.output_file] = html_of(lines, found, head="<html><body>", tail="</body></html>")
    if got.html_file != "":
        documents[got.output_file] = json_of(found)
    for path, sections in documents.items():
        if path:
            with open(path, "w", encoding="utf-8") as file:
                stream_document(sections, file)
        else:
            stream_document(sections, sys.stdout)
            print()
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
