"""python -m inkgrove FILE... : parse files, print Markdown or the JSON of tables."""

from __future__ import annotations

import argparse
import glob
import json
import sys

from inkgrove.functions.markdown import capped, capped_tables, pages_shown, rendered
from inkgrove.functions.text import is_url
from inkgrove.options import ParseOptions
from inkgrove.parsers import dispatch
from inkgrove.schema import LISTED_FAILURES, MAX_OUTPUT_BYTES, MAX_PARSE_BYTES, ParseError
from inkgrove.sources.files import fetch_one


def expanded(names: list[str]) -> list[str]:
    """Globs resolved, sorted and without repeats; addresses, - and plain names as they are."""
    out = []
    for n in names:
        if n == "-" or "://" in n or not any(c in n for c in "*?["):
            out.append(n)
            continue
        found = sorted(glob.glob(n, recursive=True))
        if not found:
            raise SystemExit(f"nothing matches {n}")
        out += found
    return list(dict.fromkeys(out))


def read(name: str, most: int) -> tuple[bytes | None, str | None, dict | None]:
    """Content, content type and error of an input: a file, - for what comes in, or a web address."""
    try:
        if is_url(name):
            data, kind, status = fetch_one(name, most=most)
            if status == "parse_budget_exceeded":
                return None, None, ParseError(status, f"input over {most} bytes", "read").row()
            return data, kind, None if status == "ok" else ParseError("parse_failed", status, "read").row()
        if name == "-":
            return sys.stdin.buffer.read(most + 1), None, None
        with open(name, "rb") as f:
            return f.read(most + 1), None, None
    except OSError as e:
        return None, None, ParseError("parse_failed", str(e), "read").row()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkgrove", description=__doc__)
    p.add_argument("inputs", nargs="+")
    p.add_argument("--format")
    p.add_argument("-m", "--mode", choices=("md", "json"))
    for name in ("--pages", "--sheet", "--rows", "--provenance", "--extract"):
        p.add_argument(name)
    p.add_argument("--columns", type=lambda x: x.split(","))
    for name in ("--limit", "--offset", "--max-work-units"):
        p.add_argument(name, type=int)
    p.add_argument("--max-output-kib", type=int, default=MAX_OUTPUT_BYTES >> 10)
    p.add_argument("--max-parse-mib", type=int, default=MAX_PARSE_BYTES >> 20)
    a = p.parse_args(args)
    budget, most = a.max_parse_mib << 20, a.max_output_kib << 10
    common = dict(format=a.format, pages=a.pages, sheet=a.sheet, rows=a.rows, columns=a.columns, limit=a.limit, offset=a.offset, max_work_units=a.max_work_units, provenance=a.provenance or "off")
    names = expanded(a.inputs)
    if a.extract:
        data, _, error = read(names[0], budget)
        if error:
            print(json.dumps({"source": names[0], "error": error}), file=sys.stderr)
            return 1
        sys.stdout.buffer.write(dispatch.media(data, a.extract, names[0]))
        return 0
    # one budget for all inputs, and one for all results: an input that doesn't fit is left out with its
    # reason and uses nothing
    rows, left, made = [], budget, 0
    failed: list[tuple[str, dict]] = []
    for n in names:
        data, kind, error = read(n, left)
        if error:
            failed.append((n, error))
            continue
        row = dispatch.parse(data, n, kind, ParseOptions.of(**common, mode={"md": "document", "json": "tables", None: "auto"}[a.mode], max_parse_bytes=max(1, left)))
        size = row["stats"]["output_bytes"] or 0
        if not row["error"] and made + size > budget:
            row["error"] = ParseError("parse_budget_exceeded", f"results over {budget} bytes").row()
        if row["error"]:
            failed.append((n, row["error"]))
            continue
        left -= len(data)
        made += size
        rows.append(row)
    for n, error in failed:
        print(json.dumps({"source": n, "error": error}), file=sys.stderr)
    if a.provenance and len(rows) == 1:
        text = json.dumps({k: rows[0][k] for k in ("source", "format", "markdown", "provenance")}, ensure_ascii=False, indent=2)
        if len(text.encode()) >= most:
            print(f"error: the result is over {most} bytes; raise --max-output-kib or take fewer pages", file=sys.stderr)
            return 1
        print(text)
    elif rows and all(r["kind"] == "tables" for r in rows):
        tables = [{k: v for k, v in t.items() if v is not None and k != "row_numbers"} for r in rows for t in r["tables"]]
        print(capped_tables(tables, most)[0])
    elif rows:
        docs = [(r["source"], r["format"], r["markdown"]) for r in rows if r["kind"] == "document"]
        # failures stand behind the text, so their room is kept free
        notes = capped("".join(f"\n> [!CAUTION]\n> {n}: {e['code']}: {e['reason']}\n" for n, e in failed[:LISTED_FAILURES]), most // 2)[0]
        text, cut = capped(rendered(docs), most - len(notes.encode()))
        sys.stdout.write(text + notes)
        pages, shown = sum(r["stats"]["page_count"] or 0 for r in rows), pages_shown(text)
        if pages and (cut or shown < pages):
            print(f"{'warning: cut after' if cut else 'info: these are'} about {shown} of {pages} pages; --pages FIRST,LAST gives others", file=sys.stderr)
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
