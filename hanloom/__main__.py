"""Command line: ``python -m hanloom convert | segment | office | build-lexicon``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import HanloomError
from .functions import text as tx
from .operators.converter import Converter
from .operators.engine import Engine
from .operators.segment import HmmModel
from .plans import configs
from .sources import files, office
from .sources import lexicon as lx


def _session() -> SparkSession:
    return SparkSession.builder.appName("hanloom").getOrCreate()


def _lexicon(args: argparse.Namespace, spark: SparkSession | None = None) -> lx.Lexicon:
    """Base tables, then user words, then custom tables."""
    base = lx.read_pack(args.pack) if args.pack else lx.read_folder(args.lexicon) if args.lexicon else lx.builtin()
    if spark is not None and args.derive:
        base = lx.derive_han_tables(spark, base)
    return lx.resolve(args.dict or [], args.user_dict or [], base)


def _write(text_bytes: bytes, target: str | None) -> None:
    if target:
        with open(target, "wb") as f:
            f.write(text_bytes)
    else:
        sys.stdout.buffer.write(text_bytes if text_bytes.endswith(b"\n") else text_bytes + b"\n")


def _document(args: argparse.Namespace, spark: SparkSession):
    if args.input:
        return files.read_texts(spark, os.path.abspath(args.input), args.in_enc)
    raw = sys.stdin.buffer.read().decode(args.in_enc, "replace")
    return spark.createDataFrame([("", raw)], "path string, text string")


def run_convert(args: argparse.Namespace) -> None:
    files.check_paths(args.input, args.output)
    for charset in (args.in_enc, args.out_enc):
        files.check_charset(charset)
    configs.config(args.config)
    spark = _session()
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    engine = Engine(spark, _lexicon(args, spark))
    out = _document(args, spark).select(files.encode(engine.convert("text", args.config, args.punct), args.out_enc, args.in_enc).alias("b"))
    _write(bytes(out.first()["b"]), args.output)


def run_segment(args: argparse.Namespace) -> None:
    files.check_paths(args.input, args.output)
    spark = _session()
    engine = Engine(spark, _lexicon(args, spark), HmmModel.read(args.hmm_model) if args.hmm_model else None)
    text = F.col("text") if args.input else F.rtrim(F.lit("\n"), tx.normalise_newlines(F.col("text")))
    out = tx.format_tags(engine.tag(text, args.hmm), args.delim, args.separator) if args.mode == "tag" else engine.cut_and_join(text, args.delim, args.hmm, args.mode)
    _write(_document(args, spark).select(out.alias("t")).first()["t"].encode(), args.output)


def run_office(args: argparse.Namespace) -> None:
    """One document needs no cluster: it is converted here. Tables of documents: ``sources.office.convert_files``."""
    files.check_paths(args.input, None)
    kind = args.format or office.kind_of(args.input)
    lexicon = _lexicon(args, _session() if args.derive else None)
    converter = Converter(lexicon, args.config)

    def one(text: str) -> str:
        return converter.convert(text, punct=args.punct)

    with open(args.input, "rb") as f:
        data, n = office.convert_bytes(f.read(), kind, one, args.keep_font, args.wide)
    target = args.output or office.converted_name(args.input)
    if args.convert_filename:
        target = os.path.join(os.path.dirname(target), one(os.path.basename(target)))
    files.check_paths(args.input, target)
    office.replace_file(target, data)
    print(f"{n} parts converted: {target}")


def run_build(args: argparse.Namespace) -> None:
    lx.write_pack(_lexicon(args), args.output, args.pretty, args.format == "zstd")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hanloom")
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--lexicon", help="folder of <slot>.txt tables")
    common.add_argument("--pack", help="lexicon pack")
    common.add_argument("-U", "--user-dict", action="append")
    common.add_argument("-D", "--dict", action="append", metavar="SLOT:MODE:FILE")
    common.add_argument("--derive", action="store_true", help="make the character tables by rule where they lack")
    inout = argparse.ArgumentParser(add_help=False)
    inout.add_argument("-i", "--input")
    inout.add_argument("-o", "--output")
    inout.add_argument("--in-enc", default="UTF-8")
    p = sub.add_parser("convert", parents=[common, inout])
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-p", "--punct", action="store_true")
    p.add_argument("--out-enc", default="UTF-8")
    p.set_defaults(run=run_convert)
    p = sub.add_parser("segment", parents=[common, inout])
    p.add_argument("-m", "--mode", choices=("cut", "search", "full", "all", "tag"), default="cut")
    p.add_argument("-d", "--delim", default="/")
    p.add_argument("-s", "--separator", default="/")
    p.add_argument("--hmm", action=argparse.BooleanOptionalAction, default=True, help="cut unknown words by the model, if there is one")
    p.add_argument("--hmm-model", help="JSON file of a hidden Markov model: start, move, emit")
    p.set_defaults(run=run_segment)
    p = sub.add_parser("office", parents=[common])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-f", "--format", choices=office.FORMATS)
    p.add_argument("-p", "--punct", action="store_true")
    p.add_argument("--keep-font", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--convert-filename", action="store_true")
    p.add_argument("--wide", action="store_true")
    p.set_defaults(run=run_office)
    p = sub.add_parser("build-lexicon", parents=[common])
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--format", choices=("zstd", "json"), default="zstd")
    p.add_argument("--pretty", action="store_true")
    p.set_defaults(run=run_build)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except HanloomError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
