"""Command line: python -m lanternq.cli -p PATH [question]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import ConfigManager, ModelSettings
from .operators.rank import debug_table
from .plans.cache import Cache
from .plans.engine import code_map, context, question_keywords, semantic_hits
from .plans.progress import StepLog
from .plans.prompt import ChatSession, prompt
from .sources.tree_source import read_source_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternq", description="Questions over a folder of code or text")
    p.add_argument("question", nargs="?", help="without it, questions are read line by line")
    p.add_argument("-p", "--path", default=".", help="folder of the corpus")
    p.add_argument("-m", "--model", help="name of the answering model")
    p.add_argument("-k", "--api-key", help="key of the answering model")
    p.add_argument("-i", "--interactive", action="store_true", help="go on with more questions")
    p.add_argument("-s", "--stream", action="store_true", help="show the answer piece by piece")
    p.add_argument("-c", "--max-context", type=int, default=0, help="characters of context (0: the default)")
    p.add_argument("-d", "--debug", action="store_true", help="show the files of the context")
    p.add_argument("--show-progress", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--cache", help="folder for results that are kept")
    p.add_argument("--env-file", default=".env", help="file of settings")
    p.add_argument("--config", action="store_true", help="show the settings and stop")
    p.add_argument("--sample-config", action="store_true", help="write a file of settings to the output and stop")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    manager = ConfigManager(args.env_file)
    config = manager.update(max_context_size=args.max_context) if args.max_context else manager.config
    model = ModelSettings.of(args.model, args.api_key)
    if args.sample_config:
        print(config.sample(), end="")
        return 0
    if args.config:
        for name, value in (vars(config) | {"model": model.model, "api_key": "set" if model.api_key else "not set"}).items():
            print(f"{name}: {value}")
        return 0
    spark = SparkSession.builder.appName("lanternq").getOrCreate()
    files = read_source_tree(spark, args.path, strict=False).filter("content is not null")
    cache = Cache(spark, args.cache, config.cache_ttl_seconds) if args.cache else None

    def prompt_of(question: str) -> str:
        log = StepLog()
        hits = semantic_hits(code_map(files, cache, log, project=args.path)[0], question) if config.semantic_analysis else None
        packed = context(files, question, config, hits, cache, log).cache()
        if args.debug:
            debug_table(packed).orderBy("rank").show(truncate=False)
        text = prompt(packed, question, question_keywords(question)).first().prompt
        if args.show_progress:
            print(log.summary(), file=sys.stderr)
        packed.unpersist()
        return text

    session = ChatSession(prompt_of)

    def one(question: str) -> None:
        if args.show_progress:
            print("Keywords:", ", ".join(question_keywords(question)), file=sys.stderr)
        if args.stream:
            for piece in session.ask_stream(question):
                print(piece, end="", flush=True)
            print()
        else:
            print(session.ask(question))

    if args.question:
        one(args.question)
        if not args.interactive:
            return 0
    for line in sys.stdin:
        line = line.strip()
        if line.lower() in ("exit", "quit", "q"):
            break
        if line:
            one(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
