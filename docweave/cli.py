"""python -m docweave COMMAND: what the library does for single files, from the command line.

Commands read a file (- for standard input) and write to standard output or --out. Folders are the business of
Spark: convert and watch start a session.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from docweave.operators import blocks, diff, forms, legal, rules, scores
from docweave.sources import binary, formats, writers


def _bytes(path: str) -> bytes:
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def _markdown(path: str, extension: str | None = None) -> str:
    data = _bytes(path)
    if Path(path).suffix.lower() in (".md", ".mdx", ".markdown"):
        return formats.decode(data)
    return formats.to_markdown(data, path if extension is None else f"stdin.{extension}")[1]


def _write(args: argparse.Namespace, result: str | bytes) -> None:
    if args.out:
        Path(args.out).write_bytes(result if isinstance(result, bytes) else result.encode())
    elif isinstance(result, bytes):
        sys.stdout.buffer.write(result)
    else:
        sys.stdout.write(result if result.endswith("\n") else result + "\n")


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=1, default=str)


def text(args: argparse.Namespace) -> str:
    return _markdown(args.file, args.ext)


def info(args: argparse.Namespace) -> str:
    data = _bytes(args.file)
    kind, markdown = formats.to_markdown(data, args.file)
    return _json({"file": args.file, "format": kind, "bytes": len(data), "characters": len(markdown), "words": len(markdown.split()), "blocks": len(blocks.parse_blocks(markdown))})


def inspect(args: argparse.Namespace) -> str:
    """Blocks as JSON."""
    return _json(blocks.parse_blocks(_markdown(args.file, args.ext)))


def redact(args: argparse.Namespace) -> str:
    chosen = args.rules.split(",") if args.rules else rules.DEFAULT_RULES
    found = _markdown(args.file, args.ext)
    if args.report:
        return _json([{"rule": rule, "start": a, "stop": b} for a, b, rule, _ in rules.pii_spans(found, chosen)])
    return rules.mask_text(found, chosen, args.mark)


def compare(args: argparse.Namespace) -> str:
    a, b = _markdown(args.file), _markdown(args.other)
    if args.mode == "unified":
        return diff.unified_diff(a, b, args.file, args.other)["diff"]
    if args.mode == "words":
        return _json(diff.word_diff(a, b))
    if args.mode == "lines":
        return _json(diff.line_diff(a, b))
    return _json(diff.diff_blocks(blocks.parse_blocks(a), blocks.parse_blocks(b)))


def chunks(args: argparse.Namespace) -> str:
    found = blocks.chunk_blocks(blocks.parse_blocks(_markdown(args.file, args.ext)), args.most, args.overlap, args.by)
    return "\n".join(json.dumps(c, ensure_ascii=False, default=str) for c in found)


def law(args: argparse.Namespace) -> str:
    rows = []
    for a in legal.article_rows(_markdown(args.file, args.ext)):
        no, branch, title = a.pop("m").groups()
        rows.append({**a, "article_number": no + (f"의{branch}" if branch else ""), "article_title": title})
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)


def generate(args: argparse.Namespace) -> bytes:
    made: dict[str, Callable[[str], bytes]] = {"docx": writers.markdown_docx, "hwpx": writers.markdown_hwpx}
    return made[args.kind](_markdown(args.file))


def validate(args: argparse.Namespace) -> str:
    return _json({"file": args.file, "issues": writers.hwpx_issues(_bytes(args.file))})


def fill(args: argparse.Namespace) -> bytes:
    made, missing = writers.fill_hwpx(_bytes(args.file), json.loads(Path(args.values).read_text(encoding="utf-8")))
    if missing:
        print(f"no field for: {', '.join(missing)}", file=sys.stderr)
    return made


def replace(args: argparse.Namespace) -> bytes:
    made, n = writers.replace_hwpx(_bytes(args.file), [tuple(p.split("=", 1)) for p in args.pairs])
    print(f"{n} replaced", file=sys.stderr)
    return made


def layout(args: argparse.Namespace) -> str:
    """The positioned text and lines of a PDF, or its Markdown."""
    data = _bytes(args.file)
    return binary.pdf_markdown(data) if args.markdown else _json(binary.pdf_layout(data))


def score(args: argparse.Namespace) -> str:
    a, b = _markdown(args.file), _markdown(args.other)
    return _json({name: metric(a, b) for name, metric in scores.METRICS.items()})


def _frame(args: argparse.Namespace):
    """A session with the text of the file in one row, for operators that are Column expressions."""
    from docweave.session import local_session

    return local_session(2).createDataFrame([(args.file, _markdown(args.file, args.ext))], "file string, text string")


def _rows(df) -> str:
    return "\n".join(json.dumps(r.asDict(True), ensure_ascii=False, default=str) for r in df.toLocalIterator())


def lint(args: argparse.Namespace) -> str:
    return _rows(rules.lint(_frame(args), "file", "text"))


def form(args: argparse.Namespace) -> str:
    return _rows(forms.inline_fields(_frame(args), "file", "text"))


def references(args: argparse.Namespace) -> str:
    return _rows(legal.references(_frame(args), "file", "text"))


def convert(args: argparse.Namespace) -> str:
    from docweave.session import local_session
    from docweave.sources import files

    spark = local_session()
    done = files.convert(files.documents(spark, args.file))
    if args.out:
        files.write_json_lines(done, args.out)
        args.out = None
        return ""
    return _rows(done)


def watch(args: argparse.Namespace) -> str:
    from docweave.session import local_session
    from docweave.streaming import watch as w

    w.watch(local_session(), args.file, args.out, args.checkpoint, args.once).awaitTermination()
    args.out = None
    return ""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple[str, dict]) -> None:
        own = commands.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        own.add_argument("file")
        own.add_argument("--out")
        own.add_argument("--ext", help="format of standard input")
        for flag, settings in options:
            own.add_argument(flag, **settings)
        own.set_defaults(run=run)

    other = ("other", {})
    command("text", text)
    command("info", info)
    command("inspect", inspect)
    command("redact", redact, ("--rules", {}), ("--mark", {"default": "●"}), ("--report", {"action": "store_true"}))
    command("diff", compare, other, ("--mode", {"choices": ["blocks", "words", "lines", "unified"], "default": "blocks"}))
    command("score", score, other)
    command("lint", lint)
    command("chunks", chunks, ("--most", {"type": int}), ("--overlap", {"type": int, "default": 0}), ("--by", {"default": "section"}))
    command("legal", law)
    command("references", references)
    command("form", form)
    command("fill", fill, ("values", {}))
    command("replace", replace, ("pairs", {"nargs": "+", "metavar": "OLD=NEW"}))
    command("generate", generate, ("--kind", {"choices": ["docx", "hwpx"], "default": "docx"}))
    command("validate", validate)
    command("layout", layout, ("--markdown", {"action": "store_true"}))
    command("convert", convert)
    command("watch", watch, ("--checkpoint", {"required": True}), ("--once", {"action": "store_true"}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        result = args.run(args)
    except (OSError, ValueError) as e:
        print(f"docweave {args.command}: {e}", file=sys.stderr)
        return 1
    if result or args.out:
        _write(args, result)
    return 0
