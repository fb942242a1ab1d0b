"""Command line: fetch, ingest, chunk, terms, preview, index, merge, search, retrieve,
answer, evaluate."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.config import BoundaryConfig, ChunkConfig, Constraints, TermAssets
from folioscan.functions import text as T
from folioscan.operators import answer, blocks, chunks, entries, evaluate, evidence, index, match, normalize, panels, render, retrieve, sections, segments, terms
from folioscan.sources import json_files, markup, scan, store


def fetch(spark, args) -> None:
    with open(args.manifest, encoding="utf-8") as f:
        print(json.dumps(scan.fetch(json.load(f), args.root, dry_run=args.dry_run, force=args.force), indent=2, default=str))


def ingest(spark, args) -> None:
    files = scan.read_rich_text(spark, args.root, args.limit, args.archives)
    names = files.select("file", "file_name", "file_stem")
    kinds = scan.read_content_types(args.types) if args.types else []
    demoted = names.filter(F.col("file_name").isin(*args.demote.split(","))) if args.demote else None
    spans = markup.spans(files)
    made = store.stored(blocks.build_blocks(spans, demoted), "blocks").join(names, "file")
    annotated = store.stored(entries.annotate(made.drop("file_name", "file_stem"), entries.find_matches(made, kinds)), "annotated").join(names, "file")
    config = BoundaryConfig(boilerplate=tuple(p for p in args.boilerplate.lower().split("|") if p))
    decided = store.stored(sections.boundary_decisions(sections.split_sections(annotated).join(names, "file"), config), "decisions")
    found = sections.with_fallback(sections.merge_sections(decided), names)
    found = sections.canonical_documents(found, names, args.source_id)
    refs = {"source_id": args.source_id, "edition": args.edition, "source_type": args.source_type, "authority_level": args.authority}
    cut = F.struct(F.col("cut_at").alias("offset"), F.lit("stat_block").alias("type"))
    none = F.array().cast("array<struct<offset:int,type:string>>")
    out = found.withColumns({k: F.lit(v) for k, v in refs.items()}).withColumn(
        "cuts", F.when(F.col("cut_at").isNotNull(), F.array(cut)).otherwise(none).cast("array<struct<offset:int,type:string>>")
    )
    mode = "overwrite" if args.force else "errorifexists"
    if args.schema:
        out = store.stored(out.withColumn("source_title", F.lit(args.title or args.source_id)), "documents")
        _keep_to(schemas.broken_documents(out, *schemas.read(args.schema)), args.schema)
    out.write.mode(mode).parquet(args.output)
    if args.records:
        named = schemas.nested_documents(spark.read.parquet(args.output)).select(F.col("document_id").alias("__file"), "record.*")
        json_files.write_records(named, args.records, "__file", args.force, drop_name=True)
    if args.extracted:
        text = spans.groupBy("file").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text")
        )
        text.withColumn("text", T.normal_text(F.col("text"))).join(names, "file").write.mode(mode).parquet(f"{args.extracted}/text")
        annotated.write.mode(mode).parquet(f"{args.extracted}/blocks")
        sections.decision_log(decided).write.mode(mode).parquet(f"{args.extracted}/decisions")


def _keep_to(broken, path: str) -> None:
    """An error if rows break a schema, with the first of them."""
    first = broken.limit(5).collect()
    if first:
        raise ValueError(f"rows break {path}: " + "; ".join(f"{r[0]}: {', '.join(r['broken'])}" for r in first))


def chunk(spark, args) -> None:
    docs = spark.read.parquet(args.documents)
    made = chunks.build_chunks(docs, ChunkConfig.of(scan.read_settings(args.settings) if args.settings else None))
    if args.schema:
        made = store.stored(made, "chunks")
        _keep_to(schemas.broken_chunks(made.withColumn("source_title", F.coalesce(F.lit(args.title), F.col("source_id"))), *schemas.read(args.schema)), args.schema)
    made.write.mode("overwrite" if args.force else "errorifexists").parquet(args.output)
    if args.records:
        named = schemas.nested(spark.read.parquet(args.output), schemas.CHUNK_FIELDS).select(F.col("chunk_id").alias("__file"), "record.*")
        json_files.write_records(named, args.records, "__file", args.force, drop_name=True)


def mine(spark, args) -> None:
    """Term assets: reviewed phrases, aliases and variants as given, mined phrases as candidates."""
    given = scan.read_settings(args.reviewed) if args.reviewed else {}
    docs, made = spark.read.parquet(args.documents), spark.read.parquet(args.chunks)
    buckets = terms.term_buckets(terms.title_terms(docs), terms.content_terms(made))
    print("\n".join(terms.write_term_assets(buckets, args.output, given.get("phrases", []), given.get("aliases", {}), given.get("variants", []))))


def preview(spark, args) -> None:
    print(panels.preview(spark.read.parquet(args.chunks)))


def build(spark, args) -> None:
    """A whole index, or with --update a commit to one in segments."""
    if not (args.update or args.delete):
        print(index.publish_index(index.build_index(spark.read.parquet(args.chunks)), args.output))
        return
    made = spark.read.parquet(args.chunks) if args.update else None
    gone = spark.read.text(args.delete).select(F.col("value").alias("chunk_id")) if args.delete else None
    print(json.dumps(segments.commit(spark, args.output, made, gone), indent=2))


def merge(spark, args) -> None:
    print(json.dumps(segments.merge(spark, args.index, fanout=args.fanout), indent=2))
    if args.vacuum:
        print("\n".join(segments.vacuum(spark, args.index)))


def search(spark, args) -> None:
    """The best chunks of a raw MATCH expression."""
    asked = spark.createDataFrame([(0, args.expression)], "query_id long, expression string")
    if told := match.malformed(asked).collect():
        raise SystemExit(f"malformed expression: {told[0]['error']}")
    found = match.search(asked, index.open_index(spark, args.index), args.top_k)
    for line in found.orderBy("rank").select("rank", "chunk_id", "document_id", "raw_score", "chunk_type", "section_path", "content").toJSON().collect():
        print(line)


def _ask(spark, args, rows):
    known = terms.read_vocabulary(spark, args.terms) if args.terms else TermAssets()
    found = index.open_index(spark, args.index)
    # without a registry nothing is filtered
    limits = Constraints.of(scan.read_registry(args.registry)) if args.registry else None
    queries = store.stored(normalize.normalize(rows, known), "queries")
    return queries, retrieve.retrieve(queries, found, limits, args.top_k)


def show(spark, args) -> None:
    rows = spark.createDataFrame([(0, args.query)], "query_id long, raw_query string")
    queries, found = _ask(spark, args, rows)
    if args.command == "retrieve" and (args.text or args.debug):
        limits = Constraints.of(scan.read_registry(args.registry)) if args.registry else None
        found = store.stored(found, "candidates")
        told = (queries, store.stored(evidence.evidence(found), "evidence"), evidence.traces(found), limits)
        print("\n\n".join(render.retrieval_text(*told)) if args.text else json.dumps(render.retrieval_json(*told)[0], indent=2, default=str))
        return
    if args.command == "retrieve":
        out = evidence.evidence(found).orderBy("rank").select("rank", "chunk_id", "score", "merge_reason", F.substring("content", 1, 200).alias("content"))
    else:
        items = evidence.evidence(found)
        decided = answer.support(queries, items)
        segments = answer.compose(items, decided)
        whole = answer.answers(queries, decided, segments)
        if args.text:
            named = whole.join(queries.select("query_id", "normalized_text"), "query_id")
            print("\n\n".join(render.answer_text(named, evidence.traces(found))))
            return
        out = answer.to_json(whole)
        if args.debug and args.registry:
            refused = retrieve.rejected(queries, index.open_index(spark, args.index), Constraints.of(scan.read_registry(args.registry)), args.top_k)
            print("\n".join(refused.toJSON().collect()))
        if args.debug:
            for table in (panels.candidate_rows(items).orderBy("rank"), answer.slot_decisions(items, decided), panels.segment_rows(segments), panels.citation_rows(segments)):
                for line in table.toJSON().collect():
                    print(line)
    for line in out.toJSON().collect():
        print(line)


def run_evaluation(spark, args) -> None:
    gold = scan.read_gold(spark, args.gold)
    rows = gold.select(F.col("eval_id").alias("query_id"), F.col("question").alias("raw_query"))
    queries, found = _ask(spark, args, rows)
    items = evidence.evidence(found)
    decided = answer.support(queries, items)
    segments = answer.compose(items, decided)
    cites = answer.cite(segments).withColumn("excerpt", F.col("text"))
    cases = gold.select(F.col("eval_id").alias("query_id"), "question", "question_type", F.col("expected_source_ids").alias("expected_sources"), F.col("expected_section_or_entry").alias("expected_path"), "expected_behavior")
    first = segments.filter("slot = 1").select("query_id", F.col("support_type").alias("primary_support"))
    distinct = cites.select("query_id", "citation_id", "source_id", "edition", "section_path", "entry_title", "excerpt").distinct()
    checks = store.stored(evaluate.citation_checks(cases, distinct, args.edition), "checks")
    done = store.stored(evaluate.outcomes(cases, decided.select("query_id", "answer_type").join(first, "query_id", "left"), checks), "outcomes")
    rows = store.stored(render.cases(cases, decided, segments, cites, checks, done), "cases")
    name = args.dataset or Path(args.gold).stem
    started = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    for path, make in ((args.json, render.report_json), (args.markdown, render.report_markdown)):
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(make(name, started, done, rows), encoding="utf-8")
    print(render.counts_text(name, done))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscan")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *names, **more):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(f"--{n}", required=True)
        for n, default in more.items():
            flag = f"--{n.replace('_', '-')}"
            c.add_argument(flag, action="store_true") if default is False else c.add_argument(flag, default=default, type=type(default) if default is not None else None)
        c.set_defaults(run=run)
        return c

    command("fetch", fetch, "manifest", "root", dry_run=False, force=False)
    command("ingest", ingest, "root", "output", source_id="source", edition="", source_type="", authority="", types=None, demote="", boilerplate="", extracted=None, records=None, schema=None, title=None, archives=False, force=False).add_argument("--limit", type=int)
    command("chunk", chunk, "documents", "output", settings=None, records=None, schema=None, title=None, force=False)
    command("terms", mine, "documents", "chunks", "output", reviewed=None)
    command("preview", preview, "chunks")
    command("index", build, "output", chunks=None, update=False, delete=None)
    command("merge", merge, "index", fanout=segments.FANOUT, vacuum=False)
    command("search", search, "expression", "index", top_k=5)
    command("retrieve", show, "query", "index", top_k=10, terms=None, registry=None, debug=False, text=False)
    command("answer", show, "query", "index", top_k=10, terms=None, registry=None, debug=False, text=False)
    command("evaluate", run_evaluation, "gold", "index", top_k=10, terms=None, registry=None, edition="", dataset="", json=None, markdown=None)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    # fetching is a matter of the driver's disk alone
    args.run(None if args.command == "fetch" else SparkSession.builder.appName("folioscan").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
