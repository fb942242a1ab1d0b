"""Texts for readers: answers, and the report of an evaluation.  All of them
render small tables that an evaluation or one question leaves."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.config import TAGS, Constraints
from folioscan.operators import evaluate

#: Fixed value: width of a rule.
RULE = "=" * 72


def banner(title: str) -> list[str]:
    return [RULE, title, RULE]


def locator(path: list[str] | None, location: str | None) -> str:
    return " | ".join([x for x in (" > ".join(path or []), location or "") if x])


def answer_text(answered: DataFrame, traces: DataFrame) -> list[str]:
    """One text per query of `answers`, in the order of their ids; traces are
    those of the retrieval."""
    seen = {r["query_id"]: r for r in traces.collect()}
    out = []
    for r in answered.orderBy("query_id").collect():
        lines = [*banner("QUERY"), f"  Raw:        {r['raw_query']}", f"  Normalized: {r['normalized_text']}", ""]
        if r["answer_type"] == "abstain":
            lines += [*banner("ABSTAIN"), f"  Trigger: {r['trigger_code']}", f"  Reason:  {r['reason']}"]
            out.append("\n".join(lines))
            continue
        lines += banner(f"ANSWER ({len(r['segments'])} segment(s))")
        for s in r["segments"]:
            lines += ["", f"[{s['segment_id']}] ({s['support_type']}) [{s['citation_id']}]"]
            lines += [f"  {line}" for line in textwrap.wrap(s["text"], 78)]
        lines += ["", *banner(f"CITATIONS ({len(r['citations'])})")]
        for c in r["citations"]:
            lines += ["", f"  [{c['citation_id']}] {c['source_id']}", f"    chunk:   {c['chunk_id']}"]
            lines += [f"    locator: {locator(c['section_path'], None)}"]
            lines += [f"    excerpt: {textwrap.shorten(c['excerpt'], 140, placeholder='…')}"]
        lines += ["", *banner("PIPELINE TRACE")]
        if (t := seen.get(r["query_id"])) is not None:
            lines += [f"  Candidates entering shaping: {t['total_candidates']}", f"  Groups formed:               {t['group_count']}"]
            lines += [f"    [{g['document_id']} / {g['section_root']}] {g['candidate_count']} items" for g in t["groups"]]
        out.append("\n".join(lines))
    return out


#: Fixed value: length of a content preview.
PREVIEW = 200


def _adjacency(item: dict) -> str:
    links = (("parent", "parent_chunk_id"), ("prev", "previous_chunk_id"), ("next", "next_chunk_id"))
    return ", ".join(f"{name}={item[c]}" for name, c in links if item.get(c)) or "(none)"


def _signals(item: dict) -> str:
    told = ["section_path_hit"] if item["section_path_hit"] else []
    told += [f"{name}={list(item[c])}" for name, c in (("exact", "exact_phrase_hits"), ("protected", "protected_phrase_hits")) if item[c]]
    told += [f"token_overlap={item['token_overlap_count']}"] if item["token_overlap_count"] else []
    return ", ".join(told) or "(none)"


def limits_of(constraints: Constraints | None) -> dict[str, list[str]]:
    """The hard filters of a search, each list in order; without a registry none."""
    if constraints is None:
        return {}
    return {
        "editions": sorted(constraints.editions), "source_types": sorted(constraints.source_types),
        "authority_levels": sorted(constraints.authority_levels), "excluded_source_ids": sorted(constraints.excluded),
    }


def _retrieved(queries: DataFrame, items: DataFrame, traces: DataFrame) -> list[tuple[dict, dict | None, list[dict]]]:
    """Each query, its trace and its evidence: what one question, or a few, found."""
    found: dict = {}
    for r in items.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r.asDict(recursive=True))
    seen = {r["query_id"]: r.asDict(recursive=True) for r in traces.collect()}
    return [(q.asDict(recursive=True), seen.get(q["query_id"]), found.get(q["query_id"], [])) for q in queries.orderBy("query_id").collect()]


def _groups(trace: dict | None, items: list[dict]) -> list[dict]:
    spans: dict = {}
    for i in items:
        spans[i["document_id"], i["section_root"]] = spans.get((i["document_id"], i["section_root"]), 0) + 1
    return [g | {"span_count": spans.get((g["document_id"], g["section_root"]), 0)} for g in (trace or {}).get("groups", [])]


def retrieval_text(queries: DataFrame, items: DataFrame, traces: DataFrame, constraints: Constraints | None = None) -> list[str]:
    """What a search did, step by step, one text per query: the query as it was
    read, the filters, the groups formed, and each piece of evidence."""
    out = []
    for q, trace, found in _retrieved(queries, items, traces):
        lines = [*banner("QUERY"), f"  Raw:        {q['raw_query']}", f"  Normalized: {q['normalized_text']}", f"  Tokens:     {q['tokens']}"]
        lines += [f"  {name} {q[c]}" for name, c in (("Protected: ", "protected_phrases"), ("Aliases:   ", "aliases_applied")) if q[c]]
        lines += ["", *banner("CONSTRAINTS"), *(f"  {k}: {v}" for k, v in limits_of(constraints).items())]
        lines += ["", *banner("PIPELINE TRACE")]
        lines += [f"  Candidates entering shaping: {(trace or {}).get('total_candidates', 0)}", f"  Groups formed:               {(trace or {}).get('group_count', 0)}"]
        for g in _groups(trace, found):
            merged = g["candidate_count"] != g["span_count"]
            size = f"{g['candidate_count']}→{g['span_count']} spans" if merged else f"{g['candidate_count']} items"
            lines.append(f"    [{g['document_id']} / {g['section_root']}] {size}")
        lines += ["", *banner(f"EVIDENCE ({len(found)} items)")]
        for n, i in enumerate(found, 1):
            several = i["merge_reason"] != "singleton"
            span = f"{i['merge_reason']}, {len(i['chunk_ids'])} chunks [{i['start_chunk_id']} → {i['end_chunk_id']}]" if several else "singleton"
            lines += [
                "", f"--- Evidence #{n} (rank {i['rank']}) ---",
                f"  chunk_id:    {i['chunk_id']}{'  (representative)' if several else ''}",
                f"  document_id: {i['document_id']}", f"  chunk_type:  {i['chunk_type']}", f"  section:     {i['section_root']}",
                f"  locator:     {locator(i['section_path'], i.get('source_location'))}", f"  span:        {span}",
                f"  adjacency:   {_adjacency(i)}", f"  signals:     {_signals(i)}",
                f"  content:     {textwrap.shorten(i['content'], PREVIEW, placeholder='…')}",
            ]
        out.append("\n".join(lines))
    return out


def retrieval_json(queries: DataFrame, items: DataFrame, traces: DataFrame, constraints: Constraints | None = None) -> list[dict]:
    """The same as one object per query."""
    out = []
    for q, trace, found in _retrieved(queries, items, traces):
        evidence = [
            {
                "rank": i["rank"], "chunk_id": i["chunk_id"], "document_id": i["document_id"], "chunk_type": i["chunk_type"], "section_root": i["section_root"],
                "source_ref": {c: i.get(c) for c in ("source_id", "edition", "source_type", "authority_level")},
                "locator": {c: i[c] for c in ("section_path", "source_location", "entry_title") if i.get(c)},
                "match_signals": {c: i[c] for c in ("exact_phrase_hits", "protected_phrase_hits", "section_path_hit", "token_overlap_count")},
                "span": {c: i[c] for c in ("chunk_ids", "start_chunk_id", "end_chunk_id", "merge_reason")},
                "adjacency": {c: i.get(c) for c in ("parent_chunk_id", "previous_chunk_id", "next_chunk_id")},
                "content": i["content"],
            }
            for i in found
        ]
        named = {"raw": "raw_query", "normalized": "normalized_text", "tokens": "tokens", "protected_phrases": "protected_phrases", "aliases_applied": "aliases_applied"}
        totals = {c: (trace or {}).get(c, 0) for c in ("total_candidates", "group_count")}
        out.append(
            {"query": {k: q[c] for k, c in named.items()}, "constraints": limits_of(constraints), "trace": totals | {"groups": _groups(trace, found)}, "evidence": evidence}
        )
    return out


def cases(gold: DataFrame, decided: DataFrame, segments: DataFrame, cited: DataFrame, checks: DataFrame, found: DataFrame) -> DataFrame:
    """One row per gold case (query_id is its eval_id): its outcome with what
    the answer was and how each citation fared."""
    lead = segments.filter("slot = 1").select(
        "query_id", F.col("text").alias("primary_excerpt"), F.col("support_type").alias("primary_support_type")
    )
    summary = cited.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.struct("citation_id", "chunk_id", "source_id", "edition", "section_path", "entry_title"))).alias("citations")
    )
    rated = checks.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("citation_id", "source_match", "section_match", "entry_match", "edition_match", "shared_tokens", "citation_mismatch")
            )
        ).alias("citation_checks")
    )
    rows = gold.join(found.select("query_id", "answer_type", "tags"), "query_id").join(decided.select("query_id", "reason"), "query_id")
    for part in (lead, summary, rated):
        rows = rows.join(part, "query_id", "left")
    return rows.select(
        F.col("query_id").alias("eval_id"), "question", "question_type", "expected_behavior",
        F.col("answer_type").alias("actual_answer_type"), "tags",
        F.struct(
            "primary_excerpt", "primary_support_type",
            F.coalesce("citations", F.from_json(F.lit("[]"), summary.schema["citations"].dataType)).alias("citations"),
            F.when(F.col("answer_type") == "abstain", F.col("reason")).alias("abstention_reason"),
        ).alias("actual_summary"),
        F.coalesce("citation_checks", F.from_json(F.lit("[]"), rated.schema["citation_checks"].dataType)).alias("citation_checks"),
    )


def summary(found: DataFrame) -> dict:
    """case_count, tag_counts (clean cases as _clean) and behavior_match_rate."""
    total = evaluate.report(found).first()
    counts = {r["tag"]: r["n"] for r in evaluate.tag_counts(found).orderBy("ord").collect()}
    counts["_clean"] = counts.pop("clean")
    return {"case_count": total["case_count"], "tag_counts": counts, "behavior_match_rate": float(total["behavior_match_rate"] or 0)}


def report_json(name: str, started: str, found: DataFrame, rows: DataFrame) -> str:
    each = [json.loads(x) for x in rows.orderBy("eval_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    return json.dumps({"dataset_id": name, "run_started_at": started, **summary(found), "cases": each}, indent=2, ensure_ascii=False)


def counts_text(name: str, found: DataFrame) -> str:
    s = summary(found)
    width = max(map(len, TAGS))
    lines = [f"Dataset:       {name}", f"Cases:         {s['case_count']}", f"Behavior match rate: {s['behavior_match_rate']:.2f}", "", "Tag counts:"]
    return "\n".join([*lines, *[f"  {tag.ljust(width)}  {n}" for tag, n in s["tag_counts"].items()]])


def _case(r: dict) -> list[str]:
    actual = r["actual_summary"]
    lines = [f"#### {r['eval_id']} — {r['question_type']} → {r['expected_behavior']}", "", f"**Question:** {r['question']}", ""]
    lines += ["**Tags:** " + ", ".join(f"`{t}`" for t in r["tags"]), ""]
    lines += [f"**Actual:** {r['actual_answer_type']} · primary support: {actual['primary_support_type'] or 'n/a'}"]
    if actual["primary_excerpt"]:
        lines.append("> " + textwrap.shorten(actual["primary_excerpt"], 200, placeholder="…"))
    elif actual["abstention_reason"]:
        lines.append(f"> _abstain: {actual['abstention_reason']}_")
    lines.append("")
    if not r["citation_checks"]:
        return lines
    said = {None: "n/a", True: "yes", False: "no"}
    known = {c["citation_id"]: c for c in actual["citations"]}
    lines += ["**Citations:**", "", "| id | source · edition | section_path | source | section | entry | tokens shared |", "|----|-----|-----|---|---|---|---|"]
    for c in r["citation_checks"]:
        of = known.get(c["citation_id"])
        where = f"{of['source_id']} · {of['edition']} | {' > '.join(of['section_path']) or '(none)'}" if of else "? | ?"
        marks = " | ".join(said[c[k]] for k in ("source_match", "section_match", "entry_match"))
        lines.append(f"| {c['citation_id']} | {where} | {marks} | {c['shared_tokens']} |")
    return lines


def report_markdown(name: str, started: str, found: DataFrame, rows: DataFrame) -> str:
    """Counts, failing cases by their first tag in the order of tags, clean ones
    in one line."""
    s = summary(found)
    lines = [f"# Phase 1 Gold-Set Eval — {name}", "", f"- **Run started:** {started}", f"- **Cases:** {s['case_count']}"]
    lines += [f"- **Behavior match rate:** {s['behavior_match_rate']:.2f}", "", "## Tag counts", "", "| tag | count |", "|---|---|"]
    lines += [*[f"| `{tag}` | {n} |" for tag, n in s["tag_counts"].items()], "", "## Failing cases", ""]
    every = [r.asDict(recursive=True) for r in rows.orderBy("eval_id").collect()]
    failing = [r for r in every if r["tags"]]
    for tag in TAGS:
        mine = [r for r in failing if r["tags"][0] == tag]
        lines += [f"### Tag: `{tag}`", ""] if mine else []
        for r in mine:
            lines += [*_case(r), ""]
    lines += [] if failing else ["_No failing cases._", ""]
    clean = [r["eval_id"] for r in every if not r["tags"]]
    lines += ["## Clean tail", "", f"_{len(clean)} clean cases ({', '.join(clean)})_" if clean else "_No clean cases._", ""]
    return "\n".join(lines)
