"""Command line: ``python -m factloom recover|beautify|rename|split|index|benchmark INPUT -o OUT``; results are tables, or files with ``--files``."""

from __future__ import annotations

import argparse
import importlib

from factloom.operators import namer, naming
from factloom.operators import text as texts
from factloom.plans.recover import Options, benchmark, name_all, recover, rename_texts
from factloom.plans.scratch import cut
from factloom.plans.session import local_session
from factloom.sources import files
from factloom.sources.beautify import beautify
from factloom.sources.facts import facts


def _namer(path: str | None):
    """``plain``, or ``module:function``; none if not given."""
    if not path:
        return None
    if path == "plain":
        return namer.plain_namer
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("command", choices=["recover", "beautify", "rename", "split", "index", "benchmark"])
    p.add_argument("input")
    p.add_argument("-o", "--output", default="recovered")
    p.add_argument("--files", action="store_true", help="write files beside the tables")
    p.add_argument("--seeds", help="JSON object of mangled and new names")
    p.add_argument("--property-rules", help="JSON object of properties, each with a type and a score")
    p.add_argument("--min-confidence", type=float, default=3)
    p.add_argument("--indent", type=int, default=2)
    p.add_argument("--no-hints", action="store_true", help="leave ranks and places of names out")
    p.add_argument("--namer", help="plain, or module:function from a prompt to an answer")
    p.add_argument("--model", default="", help="whose profile sets the size of a batch")
    p.add_argument("--batch", type=int, help="names in one prompt")
    p.add_argument("--max-names", type=int, help="names of a source that the namer is asked about")
    p.add_argument("--passes", type=int, default=1)
    p.add_argument("--graph", action="store_true", help="pass names on between related names")
    p.add_argument("--graph-seeds", type=int, default=3)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session()
    sources = files.read_sources(spark, a.input)
    seeds = files.read_seeds(spark, a.seeds) if a.seeds else None
    properties = tuple(files.read_property_rules(spark, a.property_rules)) if a.property_rules else ()
    options = Options(a.min_confidence, a.indent, not a.no_hints, properties, _namer(a.namer), a.batch or namer.profile(a.model).batch, a.passes, a.max_names, a.graph, a.graph_seeds)
    if a.command == "recover":
        r = recover(sources, seeds, options)
        maps, index = files.rename_json(r.renames), files.symbol_documents(r.symbols)
        files.write_outputs(a.output, pretty=r.pretty, renamed=r.renamed, maps=maps, modules=files.last_modules(r.modules), index=index, report=r.report)
        if a.files:
            files.write_files(files.documents(r.renamed, maps, files.last_modules(r.modules), index, files.report_json(r.report)), a.output)
        print(files.summary(r.report, r.stats))
    elif a.command == "beautify":
        files.write_outputs(a.output, pretty=beautify(sources, "text", a.indent, "text"))
    elif a.command == "rename":
        found = cut(facts(sources, "key", "text"), "facts")
        renames = cut(name_all(found, sources, seeds, options), "renames")
        files.write_outputs(a.output, renamed=rename_texts(sources, renames), maps=files.rename_json(renames, naming.stats(found, renames)))
    elif a.command == "split":
        files.write_outputs(a.output, modules=files.last_modules(texts.extract_modules(sources, "key", "text")))
    elif a.command == "benchmark":
        files.write_outputs(a.output, benchmark=benchmark(sources, seeds, options))
    else:
        files.write_outputs(a.output, index=files.symbol_documents(naming.symbols(facts(sources, "key", "text"))))


if __name__ == "__main__":
    main()
