"""The command line: index, search, search_dataset, answer, answer_dataset, evaluate and serve."""

from __future__ import annotations

import argparse
import sys

from sparrowdex import validate


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparrowdex", description="Retrieval over a text corpus on Spark.")
    out.add_argument("--home", default="data/processed", help="folder of the index, shared by driver and executors")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, how in options:
            p.add_argument(flag, **how)

    bonus = ("--bonus", {"default": "n", "help": "y: embeddings, hybrid ranking and caches"})
    k = lambda n: ("--k", {"type": int, "default": n})
    results = ("--student_search_results_path", {"required": True})
    command("index", ("--max_chunk_size", {"type": int, "default": 800}), ("--corpus", {"default": "data/raw"}), bonus)
    command("search", ("query", {}), k(5), bonus)
    command("search_dataset", ("--dataset_path", {"required": True}), k(5), ("--save_directory", {"default": "data/output/search_results"}), bonus)
    command("answer", ("query", {}), k(3))
    command("answer_dataset", results, ("--save_directory", {"default": "data/output/answers"}), bonus)
    command("evaluate", results, ("--dataset_path", {"required": True}), k(10))
    command("serve", ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8000}), bonus)
    return out


def cache_line(engine) -> None:
    if engine.cache_use:
        print("Questions: {questions}, from the cache: {hits}".format(**engine.cache_use))


def run(engine, a: argparse.Namespace) -> None:
    """One command; what it reports goes to the standard output."""
    bonus = validate.flag(getattr(a, "bonus", "n"))
    match a.command:
        case "index":
            print(f"Index published: {engine.index(a.corpus, a.max_chunk_size, bonus)}")
            print("Files: {files}, skipped by kind: {skipped}, not UTF-8: {unreadable}".format(**engine.seen))
        case "search":
            for r in engine.search(a.query, a.k, bonus).collect():
                print(f"{r['path']} [{r['first']}:{r['last']}]")
        case "search_dataset":
            print(f"Results saved: {engine.search_dataset(a.dataset_path, validate.count(a.k), a.save_directory, bonus)}")
            cache_line(engine)
        case "answer":
            print(engine.answer(a.query, a.k))
        case "answer_dataset":
            print(f"Answers saved: {engine.answer_dataset(a.student_search_results_path, a.save_directory, bonus)}")
            cache_line(engine)
        case "evaluate":
            rows = engine.evaluate(a.student_search_results_path, a.dataset_path, a.k).collect()
            print(f"Questions: {rows[0]['num_questions']}")
            for r in rows:
                print(f"Recall@{r['k']}: {r['recall']:.2f} ({r['recall'] * 100:.2f}%)")
        case "serve":
            from sparrowdex.server import make

            with make(engine, a.host, validate.port(a.port), bonus) as server:
                print(f"Listening on {a.host}:{a.port}")
                server.serve_forever()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from sparrowdex.engine import Engine

    try:
        run(Engine(SparkSession.builder.appName("sparrowdex").getOrCreate(), a.home), a)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the user gets a sentence, the shell a code
        red, plain = ("\033[31m", "\033[0m") if sys.stderr.isatty() else ("", "")
        print(f"{red}{type(e).__name__}: {e}{plain}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
