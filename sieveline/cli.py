"""Commands for single files (keygen, analyze, embed, extract) and for tables (prepare, evaluate, compare, confirm, report).

Outputs are never overwritten, but for reports, which are replaced as a whole.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from fractions import Fraction
from pathlib import Path

from sieveline.kernels import codec, images


def _rate(text: str, pixels: int, stored: int, keyed: bool) -> Fraction:
    if text != "auto":
        return Fraction(text)
    overhead = codec.SALT + codec.HEADER + (codec.MAC if keyed else codec.CHECKSUM)
    return max(Fraction(1, 400), Fraction(8 * (stored + overhead), pixels))


def _create(path: str, data: bytes) -> None:
    with open(path, "xb") as f:
        f.write(data)


def analyze(cover: bytes, message: bytes, key: bytes | None, rate: str) -> dict:
    """Sizes of a frame at the chosen and the suggested rate, without any coding."""
    pixels, (flag, stored) = images.decode_png(cover).size, codec.choose(message)
    out = {"requested_rate": rate, "message_bytes": len(message), "stored_bytes": len(stored), "compressed": bool(flag)}
    for name, text in (("chosen", rate), ("suggested", "auto")):
        r = _rate(text, pixels, len(stored), key is not None)
        total = int(pixels * r // 8)
        room = total - codec.SALT - codec.HEADER - (codec.MAC if key is not None else codec.CHECKSUM)
        out[name] = {
            "rate": str(r), "frame_bytes": total, "capacity_bytes": room, "gross_bpp": 8 * total / pixels, "net_bpp": 8 * len(message) / pixels,
            "fits": len(stored) <= room, "supported": Fraction(1, 400) <= r <= Fraction(1, 5),
        }
    return out


#: Commands over a folder of tables; all but the report write JSON.
FLOWS = ("prepare", "evaluate", "compare", "confirm", "report")


class Stages:
    """Seconds of each stage of a command, told as it goes on."""

    def __init__(self, clock=time.monotonic):
        self._clock, self._open, self.done = clock, None, []

    def __call__(self, percent: int, stage: str) -> None:
        now = self._clock()
        if self._open:
            name, began = self._open
            self.done.append({"stage": name, "seconds": now - began})
        self._open = None if stage == "done" else (stage, now)


def run_flow(args: argparse.Namespace) -> dict:
    """Run one of FLOWS in a local session, or in the session there is."""
    from sieveline.plans import flows
    from sieveline.session import build_session, intermediates, path_exists
    from sieveline.sources.files import create_json

    spark = build_session()
    if args.command != "report" and path_exists(spark, args.output):
        raise FileExistsError(f"{args.output} is already there")
    with intermediates(spark):
        if args.command == "report":
            flows.report(spark, args.tables, args.output)
        elif args.command == "confirm":
            create_json(flows.e_confirm(spark, args.tables, args.strict), args.output)
        else:
            create_json(getattr(flows, f"e_{args.command}")(spark, args.tables), args.output)
    return {"written": args.output}


def run(args: argparse.Namespace, stages: Stages) -> dict:
    if args.command in FLOWS:
        return run_flow(args)
    if args.command == "keygen":
        from sieveline.sources.files import new_key

        _create(args.output, new_key())
        return {"written": args.output}
    key = Path(args.key).read_bytes() if args.key else None
    if key is not None and len(key) != 32:
        raise ValueError("a key has exactly 32 bytes")
    data = Path(args.image).read_bytes()
    if args.command == "extract":
        r = Fraction(args.rate)
        _create(args.output, codec.extract(images.decode_png(data), (r.numerator, r.denominator), key))
        return {"written": args.output}
    message = Path(args.message).read_bytes()
    if args.command == "analyze":
        return analyze(data, message, key, args.rate)
    cover = images.decode_png(data)
    r = _rate(args.rate, cover.size, len(codec.choose(message)[1]), key is not None)
    stego, info = codec.embed(cover, message, (r.numerator, r.denominator), key, args.strategy == "balanced", progress=stages)
    encoded = images.encode_png(stego)
    if codec.extract(images.decode_png(encoded), (r.numerator, r.denominator), key) != message:
        raise RuntimeError("the written image does not give the message back")
    _create(args.output, encoded)
    return {"written": args.output, "rate": str(r), **info}


def main(argv: list[str] | None = None) -> int:
    """Run one command; with --output-logs its status, seconds and error go to a new JSON file."""
    parser = argparse.ArgumentParser(prog="sieveline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("keygen", "analyze", "embed", "extract"):
        c = commands.add_parser(name)
        c.add_argument("--output-logs")
        if name != "analyze":
            c.add_argument("--output", required=True)
        if name != "keygen":
            c.add_argument("--image", required=True)
            c.add_argument("--key")
            c.add_argument("--rate", default="auto" if name != "extract" else None, required=name == "extract")
        if name in ("analyze", "embed"):
            c.add_argument("--message", required=True)
        if name == "embed":
            c.add_argument("--strategy", choices=("baseline", "balanced"), default="balanced")
    for name in FLOWS:
        c = commands.add_parser(name)
        for option in ("--tables", "--output"):
            c.add_argument(option, required=True)
        c.add_argument("--output-logs")
        if name == "confirm":
            c.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    began, status, error, result, stages = time.monotonic(), "done", None, {}, Stages()
    try:
        result = run(args, stages)
        print(json.dumps(result, indent=1))
    except (ValueError, OSError) as e:
        status, error = "failed", str(e)
        print(error, file=sys.stderr)
    if args.output_logs:
        log = {"action": args.command, "status": status, "seconds": time.monotonic() - began, "stages": stages.done, "error": error}
        with open(args.output_logs, "x", encoding="utf-8") as f:
            json.dump(log, f, allow_nan=False)
    return int(status != "done")


if __name__ == "__main__":
    sys.exit(main())
