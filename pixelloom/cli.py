"""Command lines: ``python -m pixelloom.cli {convert,stitch,process,subset} ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pixelloom import __version__, api

COMPRESSIONS = ["None", "LZW", "zstd"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixelloom")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("-d", "--output_type", choices=["uint16", "float32"], default="uint16")
        c.add_argument("-c", "--compression", choices=COMPRESSIONS, default="zstd")
        return c

    for name, text in (("convert", "one image a region"), ("stitch", "one mosaic")):
        c = add(name, text)
        if name == "stitch":
            c.add_argument("-r", "--roi")
        c.add_argument("input_path", type=Path)
        c.add_argument("output_path", type=Path, nargs="?")
    c = add("process", "several operations over one or many containers")
    for flag, long in (("-x", "--convert"), ("-s", "--stitch"), ("-m", "--metadata"), ("-p", "--pyramid")):
        c.add_argument(flag, long, action="store_true")
    c.add_argument("-P", "--panorama", nargs="?", const="all")
    c.add_argument("-R", "--roi_map", nargs="?", const="all")
    c.add_argument("-f", "--filter")
    c.add_argument("-r", "--roi")
    c.add_argument("input_path", type=Path)
    c.add_argument("output_path", type=Path, nargs="?")
    c = add("subset", "channels and pyramids of images")
    c.add_argument("-l", "--list_channels", action="store_true")
    c.add_argument("-f", "--filter")
    c.add_argument("-p", "--pyramid", action="store_true")
    c.add_argument("input_path", type=Path)
    c.add_argument("output_path", type=Path, nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    a = parser.parse_args(argv)
    if not a.input_path.exists():
        parser.error(f"{a.input_path} does not exist")
    if a.command in ("convert", "stitch"):
        if a.input_path.is_dir():
            parser.error("a folder is not taken here; use process")
        if a.input_path.suffix.lower() != ".mcd":
            parser.error(f"expected a .mcd file (got: {a.input_path.name})")
    try:
        if a.command == "convert":
            api.convert(a.input_path, a.output_path, a.output_type, a.compression)
        elif a.command == "stitch":
            api.stitch(a.input_path, a.output_path, a.output_type, a.compression, a.roi)
        elif a.command == "process":
            if not (a.convert or a.stitch or a.metadata or a.panorama is not None):
                print("Error: no operation selected\n", file=sys.stderr)
                parser.print_help(sys.stderr)
                return 1
            if a.roi and a.input_path.is_dir():
                parser.error("--roi takes a single file, not a folder")
            if a.roi_map is not None and not (a.convert or a.stitch):
                parser.error("--roi_map needs --convert or --stitch")
            if (a.filter or a.pyramid) and not (a.convert or a.stitch):
                parser.error("--filter and --pyramid need --convert or --stitch")
            api.process(a.input_path, a.output_path, a.convert, a.stitch, a.panorama, a.metadata, a.roi_map, a.filter, a.pyramid, a.roi, a.output_type, a.compression)
        else:
            if a.list_channels and (a.filter or a.pyramid):
                parser.error("--list_channels excludes --filter and --pyramid")
            if not (a.list_channels or a.filter or a.pyramid):
                parser.error("one of --list_channels, --filter and --pyramid is needed")
            api.tiff_subset(a.input_path, a.output_path, a.output_type, a.compression, a.filter, a.pyramid, a.list_channels)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
