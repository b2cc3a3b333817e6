"""python -m seqframe primers FASTA NAME=SEQ ... | search FASTQ OUT NAME=SEQ ..."""

from __future__ import annotations

import argparse

from seqframe.plans import pipelines
from seqframe.schema import parse_primers
from seqframe.session import build_session
from seqframe.sources.tables import write_matches, write_report


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqframe")
    commands = parser.add_subparsers(dest="command", required=True)
    primers = commands.add_parser("primers", help="align primers with the sequences of a FASTA file")
    primers.add_argument("fasta")
    primers.add_argument("primer", nargs="+", help="NAME=SEQ")
    primers.add_argument("--threshold", type=float, default=80.0)
    primers.add_argument("--denominator", choices=("primer", "sequence"), default="primer")
    primers.add_argument("--no-reverse", action="store_true")
    primers.add_argument("--json", help="folder for the report as JSON lines")
    find = commands.add_parser("search", help="find motifs in a FASTQ file within an edit budget")
    find.add_argument("fastq")
    find.add_argument("out", help="folder for matches as Parquet")
    find.add_argument("motif", nargs="+", help="NAME=SEQ")
    find.add_argument("--threshold", type=float, default=0.9)
    for p in (primers, find):
        p.add_argument("--master", default="local[*]")
    given = parser.parse_args(arguments)
    spark = build_session(given.master)
    if given.command == "primers":
        report, summary = pipelines.primer_analysis(spark, given.fasta, parse_primers(given.primer, not given.no_reverse), given.threshold, denominator=given.denominator)
        if given.json:
            write_report(report, given.json)
        print(summary.first().asDict())
    else:
        found, by_motif = pipelines.search_file(spark, given.fastq, parse_primers(given.motif, False), given.threshold)
        write_matches(found, given.out)
        by_motif.show(truncate=False)


if __name__ == "__main__":
    main()
