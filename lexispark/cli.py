"""A small prompt over an engine: ``python -m lexispark.cli [config.yaml]``."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.parser import QueryError
from .result import Result

HELP = """Words and operators:   fox    fox AND dog    fox OR cat    fox AND NOT snake    (fox OR cat) AND dog
Patterns (on stems):   ocea*    sci*ist    *tion
Dates:                 DATE:[2024-01-01,2024-12-31]    VALID:[...]    APPEARED:[...]
Commands:              :stats    :help    :quit"""


def banner(engine: Engine) -> str:
    c = engine.config
    return "\n".join(
        [
            "lexispark",
            f"  backend    : {c.storage.backend or 'memory'}",
            f"  language   : {c.language}",
            f"  source     : {c.source.dir}",
            f"  stemming   : {c.index.stemming}",
            f"  stop words : {c.index.stop_words}",
        ]
    )


def shown(result: Result) -> str:
    """An answer as lines of id and file name; rows come to the driver one partition at a time."""
    rows = result.documents().select("doc_id", "filename").toLocalIterator()
    lines = [f"    [{r['doc_id']}] {r['filename']}" for r in rows]
    return "\n".join([f"  Found {len(lines)} document(s):", *lines]) if lines else "  No documents found."


def answer(engine: Engine, line: str) -> str | None:
    """What a line prints; None ends."""
    line = line.strip()
    if line in (":quit", ":q"):
        return None
    if line == ":help":
        return HELP
    if line == ":stats":
        return "  " + str(engine.stats()) + ("\n" + engine.storage_report()).rstrip()
    if not line:
        return ""
    try:
        return shown(engine.query(line))
    except QueryError as e:
        return f"  Error: {e}"


def loop(engine: Engine, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    while True:
        try:
            out = answer(engine, read("> "))
        except EOFError:
            return
        if out is None:
            return
        if out:
            write(out)


def main() -> None:
    spark = SparkSession.builder.appName("lexispark").getOrCreate()
    engine = Engine.from_path(spark, sys.argv[1]) if len(sys.argv) > 1 else Engine(spark)
    print(banner(engine))
    engine.index_source()
    stats = engine.stats()
    print(f"{stats.docs} docs, {stats.terms} terms indexed.")
    loop(engine)
    engine.close()


if __name__ == "__main__":
    main()
