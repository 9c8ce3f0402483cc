"""Command line: index a folder of documents, ask an index by any method, evaluate methods on questions."""

from __future__ import annotations

import argparse

from loomgraph.operators import evaluation, methods, models
from loomgraph.plans.pipeline import ask, build_index, evaluate
from loomgraph.session import build_session
from loomgraph.sources.files import IndexConfig, load_documents, load_index, load_questions, save_index, write_graphml


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build an index from a folder of documents")
    i.add_argument("--input", required=True)
    i.add_argument("--pattern", default="*.md")
    i.add_argument("--gazetteer", required=True, help="Parquet with name and type")
    i.add_argument("--output", required=True)
    i.add_argument("--graphml", help="also write the graph to this file")
    i.add_argument("--model", default="", help="extract with a model: rules | openai | anthropic | ollama")
    i.add_argument("--embedder", default="hashing:512")
    i.add_argument("--chunk-size", type=int, default=300)
    i.add_argument("--overlap", type=int, default=50)
    i.add_argument("--max-gleanings", type=int, default=1)
    i.add_argument("--max-cluster-size", type=int, default=10)
    i.add_argument("--no-claims", action="store_true")
    q = sub.add_parser("query", help="ask a question")
    q.add_argument("--index", required=True)
    q.add_argument("--method", default="local", choices=methods.NAMES)
    q.add_argument("--level", type=int, help="level of the reports of a global search")
    q.add_argument("--dynamic", action="store_true", help="select the reports of a global search from the top down")
    q.add_argument("--show-context", action="store_true")
    q.add_argument("question")
    e = sub.add_parser("eval", help="score methods on questions")
    e.add_argument("--index", required=True)
    e.add_argument("--questions", required=True, help="lines of JSON")
    e.add_argument("--methods", default="basic,local,global,ppr,hybrid")
    e.add_argument("--judge", action="store_true", help="also judge the first two methods by pairs")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session()
    if args.command == "index":
        config = IndexConfig(chunk_size=args.chunk_size, overlap=args.overlap, max_gleanings=args.max_gleanings, max_cluster_size=args.max_cluster_size, extract_claims=not args.no_claims, embedder=args.embedder)
        gazetteer = spark.read.parquet(args.gazetteer)
        make = None
        if args.model == "rules":
            known = {r["name"]: r["type"] for r in gazetteer.select("name", "type").collect()}
            make = lambda: models.RuleModel(known)
        elif args.model:
            models.get_model(args.model)
            make = lambda: models.get_model(args.model)
        index = build_index(load_documents(spark, args.input, args.pattern), gazetteer, config, make, args.model or "rules")
        save_index(index, args.output)
        if args.graphml:
            saved = load_index(spark, args.output)
            write_graphml(saved.entities, saved.relationships, args.graphml)
        return 0
    index = load_index(spark, args.index)
    if args.command == "query":
        options = {"level": args.level, "dynamic": args.dynamic} if args.method == "global" else {}
        r = ask(index, args.question, args.method, **options).first()
        if args.show_context:
            print(r["context"])
        print(r["answer"])
        print(f"[method={r['method']} llm_calls={r['llm_calls']} sources={', '.join(r['sources']) or '-'}]")
        return 0
    names = [m.strip() for m in args.methods.split(",") if m.strip()]
    results, means = evaluate(index, load_questions(spark, args.questions), names)
    for r in evaluation.report_lines(means).orderBy("system", "group").collect():
        print(r["line"])
    if args.judge and len(names) > 1:
        won = evaluation.judged_pairs(results.select("question_id", results["method"].alias("system"), "answer"), *names[:2])
        for r in evaluation.win_table(won).collect():
            print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
