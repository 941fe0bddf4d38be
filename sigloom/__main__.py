"""python -m sigloom COMMAND: the pipelines from the command line, from Parquet, FASTA or FAST5 to text."""

from __future__ import annotations

import argparse
import dataclasses
import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession

from sigloom import __version__
from sigloom.plans import pipelines
from sigloom.sources import readers, sinks

ABOUT = {
    "raw": "basecall from raw signal",
    "events": "basecall from events",
    "event_table": "detect events",
    "squiggle": "predict the signal of sequences",
    "mappy": "map signal to a sequence's squiggle",
    "seqmappy": "map signal to a sequence by a basecalling model",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version", help="print the version")
    sub.add_parser("licence", aliases=["license"], help="print the licence")
    for name, text in ABOUT.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("input", help="Parquet of reads (read_id, uuid, signal), a folder of FAST5 files, or for squiggle FASTA")
        p.add_argument("output", help="folder for text")
        p.add_argument("--params", help="Parquet parameter table (model, tensor, shape, values)")
        p.add_argument("--format", default=None, help="fasta, sam or tsv, as the command allows")
        if name in ("mappy", "seqmappy"):
            p.add_argument("--sequence", required=True, help="FASTA; its first record is mapped to")
        for f in ("model", "min_prob", "stay_penalty", "skip_penalty", "local_penalty", "weight_temperature", "bias_temperature", "trim", "segmentation", "homopolymer", "prefix"):
            p.add_argument(f"--{f.replace('_', '-')}", default=None)
        for f in ("use_uuid", "slip", "no_dwell", "rescale"):
            p.add_argument(f"--{f.replace('_', '-')}", action="store_true")
        p.add_argument("--limit", type=int, default=0)
    return top


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return readers.fast5(spark, path) if path.rstrip("/").endswith((".fast5", "fast5")) else spark.read.parquet(path)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The lines that the command writes."""
    pipeline, formats = pipelines.command(args.command)
    squiggles = args.command in ("squiggle", "mappy")
    texts = {f.name: getattr(args, f.name) for f in dataclasses.fields(pipelines.Options) if getattr(args, f.name, None) is not None}
    texts = {k: v for k, v in texts.items() if k not in ("limit", "use_uuid", "slip") and not (k == "model" and squiggles)}
    if args.command == "seqmappy":
        texts.setdefault("local_penalty", "4.0")
    options = dataclasses.replace(pipelines.Options.parse(**texts), limit=args.limit, slip=args.slip, use_uuid=args.use_uuid, dwell_correction=not args.no_dwell)
    model = args.model or ("squiggle_r94" if squiggles else "events" if args.command == "events" else options.model)
    params = readers.parameters_from_table(spark.read.parquet(args.params), model) if args.params else {}
    if args.command == "squiggle":
        out = pipeline(readers.fasta(spark, args.input), params, model, args.rescale, args.limit)
    elif args.command == "event_table":
        out = pipeline(_reads(spark, args.input), options)
    else:
        df = _reads(spark, args.input)
        if args.command in ("mappy", "seqmappy"):
            df = df.crossJoin(readers.fasta_first(spark, args.sequence).select("seq").limit(1))  # one row
        out = pipeline(df, params, model, options) if args.command == "mappy" else pipeline(df, params, options=options)
    form = args.format or next(iter(formats))
    if form not in formats:
        raise ValueError(f"{args.command} writes {', '.join(formats)}")
    lines = formats[form](out, args.prefix or "", args.use_uuid) if form in ("fasta", "sam") else formats[form](out)
    return lines.select("value")


def licence() -> str:
    """The licence file beside the package, if it comes with one."""
    top = pathlib.Path(__file__).resolve().parent.parent
    found = [p for name in ("LICENCE", "LICENSE", "LICENSE.md") if (p := top / name).is_file()]
    return found[0].read_text().strip() if found else f"sigloom {__version__} comes without a licence file"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command in ("licence", "license"):
        print(licence())
        return 0
    spark = SparkSession.builder.appName(f"sigloom-{args.command}").getOrCreate()
    sinks.write_text(run(spark, args), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
