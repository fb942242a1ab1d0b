"""Queries of the corpus side: blocks, entries, sections, chunks, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.config import BoundaryConfig, ChunkConfig
from folioscan.functions import text as T
from folioscan.operators import blocks as B
from folioscan.operators import chunks as K
from folioscan.operators import entries as E
from folioscan.operators import sections as S
from folioscan.operators import terms as R
from folioscan.sources import markup, store

from . import tables as D
from .tables import CANONICAL_SQL, FILE_NAME_SQL, SPANS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents")


# --- sources, text functions --------------------------------------------------


@query(
    "src2_checksums",
    "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, "
    "md5(text) = md5(trim(text)) AS verified FROM documents",
)
def src2_checksums(spark, sf):
    raw = F.col("text").cast("binary")
    return docs(spark, sf).select(
        "doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"),
        (F.md5(raw) == F.md5(F.trim("text").cast("binary"))).alias("verified"),
    )


@query(
    "ext3_normal_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(text, chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'),
      '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""",
)
def ext3_normal_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normal_text(F.col("text")).alias("text"))


@query(
    "sec1_slug",
    r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug
    FROM documents""",
)
def sec1_slug(spark, sf):
    return docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("slug"))


# --- blocks -------------------------------------------------------------------

HEADING_SQL = r"""(length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.!?;,:]$')
  AND len(regexp_extract_all(text, '[A-Za-z][A-Za-z''/-]*')) BETWEEN 1 AND 12
  AND len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''/-]*'), lambda w: regexp_matches(w, '^[A-Z]')))
    / greatest(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''/-]*')), 1) >= 0.7)"""

BLOCKS_SQL = (
    SPANS_SQL
    + r""",
cut AS (
  SELECT file, span_no, font_size, bold, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1
      + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY file ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no
  FROM spans),
seen AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS seen FROM cut WHERE text <> ''),
sizes AS (
  SELECT file, line_no, font_size, row_number() OVER (PARTITION BY file, line_no ORDER BY sum(seen) DESC, min(span_no)) AS r
  FROM seen WHERE seen > 0 GROUP BY file, line_no, font_size),
summary AS (
  SELECT file, line_no, string_agg(text, '' ORDER BY span_no) AS text,
    coalesce(first(bold ORDER BY span_no) FILTER (seen > 0), false) AS starts_with_bold,
    coalesce(bool_and(bold) FILTER (seen > 0), false) AS all_bold, bool_or(bold) AS any_bold
  FROM seen GROUP BY file, line_no),
measured AS (
  SELECT m.*, coalesce(z.font_size, 0) AS font_size FROM summary m
  LEFT JOIN sizes z ON z.file = m.file AND z.line_no = m.line_no AND z.r = 1),
modes AS (
  SELECT file, font_size, count(*) AS n FROM (
    SELECT *, bool_or(NOT any_bold) OVER (PARTITION BY file) AS has_plain FROM measured)
  WHERE (NOT any_bold OR NOT has_plain) AND font_size > 0 GROUP BY file, font_size),
base AS (SELECT file, first(font_size ORDER BY n DESC, font_size DESC) AS baseline FROM modes GROUP BY file),
tidy AS (
  SELECT m.* EXCLUDE (text), coalesce(baseline, 0) AS baseline,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text
  FROM measured m LEFT JOIN base b ON b.file = m.file),
blocks AS (
  SELECT file, (row_number() OVER (PARTITION BY file ORDER BY line_no) - 1)::INT AS block_no,
    CASE WHEN contains(text, ' | ') THEN 'table_row' WHEN regexp_matches(text, '^(\d+[.)]|[-*])\s+') THEN 'list_item'
      WHEN __HEADING__ THEN CASE WHEN file % 10 = 0 THEN 'paragraph' ELSE 'heading_candidate' END
      ELSE 'paragraph' END AS block_type,
    text, line_no, font_size,
    CASE WHEN baseline = 0 OR font_size = 0 THEN 'body' WHEN font_size > baseline THEN 'larger' WHEN font_size < baseline THEN 'smaller' ELSE 'body' END AS font_size_class,
    starts_with_bold, all_bold
  FROM tidy WHERE text <> '')"""
).replace("__HEADING__", HEADING_SQL)


def blocks(spark, sf) -> DataFrame:
    every = docs(spark, sf)
    demoted = D.files(every).filter("file % 10 = 0").select("file")
    # read several times below: once by each kind of entry and by its descriptions
    return store.stored(B.build_blocks(D.styled_spans(every), demoted), "blocks")


@query(
    "ext11_blocks",
    f"WITH {BLOCKS_SQL} SELECT file, block_no, 'b' || lpad((block_no + 1)::VARCHAR, 4, '0') AS block_id, block_type, text, line_no, "
    "font_size, font_size_class, starts_with_bold, all_bold FROM blocks",
)
def ext11_blocks(spark, sf):
    return blocks(spark, sf)


@query("ext9_baselines", f"WITH {BLOCKS_SQL} SELECT DISTINCT m.file, coalesce(baseline, 0) AS baseline FROM measured m LEFT JOIN base b ON b.file = m.file")
def ext9_baselines(spark, sf):
    return B.baselines(B.summarize(B.split_lines(D.styled_spans(docs(spark, sf)))))


@query(
    "ext2_merged_spans",
    f"""WITH {SPANS_SQL}, turned AS (
      SELECT *, coalesce((font_size, bold) IS DISTINCT FROM lag((font_size, bold)) OVER w, true) AS turn FROM spans WINDOW w AS (PARTITION BY file ORDER BY span_no)),
    runs AS (SELECT *, sum(turn::INT) OVER (PARTITION BY file ORDER BY span_no) AS run FROM turned)
    SELECT file, run, font_size, bold, string_agg(text, '' ORDER BY span_no) AS text FROM runs GROUP BY file, run, font_size, bold""",
)
def ext2_merged_spans(spark, sf):
    return B.merge_spans(D.styled_spans(docs(spark, sf)))


@query(
    "ext1_rich_text",
    f"""WITH {SPANS_SQL}, turned AS (
      SELECT *, coalesce((font_size, bold) IS DISTINCT FROM lag((font_size, bold)) OVER w, true) AS turn FROM spans WINDOW w AS (PARTITION BY file ORDER BY span_no)),
    runs AS (SELECT *, sum(turn::INT) OVER (PARTITION BY file ORDER BY span_no) AS run FROM turned)
    SELECT file, run - 1 AS span_no, font_size, bold, string_agg(text, '' ORDER BY span_no) AS text FROM runs GROUP BY file, run, font_size, bold""",
)
def ext1_rich_text(spark, sf):
    """Spans written as rich text, and read again: neighbours of one format are one."""
    made = markup.as_rich_text(D.styled_spans(docs(spark, sf)))
    return markup.spans(made)


@query("ext1_page_spans", None)
def ext1_page_spans(spark, sf):
    pages = D.table(spark, sf, "pages").select(F.col("page_id").alias("file"), "html")
    return markup.spans(pages, "html", "page")


# --- entries ------------------------------------------------------------------


def _statblock_sql(name, category, chunk_type, files, title_max, subtitle_max, min_fields) -> str:
    return f"""
  SELECT file, block_no AS start, fields_end, coalesce(stop, hard_stop) AS "end", text AS entry_title,
    '{name}' AS entry_type, '{category}' AS entry_category, '{chunk_type}' AS entry_chunk_type, 'entry_with_statblock' AS shape_family
  FROM (
    SELECT m.*, (SELECT min(h.block_no) FROM eblocks h WHERE h.file = m.file AND h.block_type = 'heading_candidate' AND h.block_no >= m.fields_end AND h.block_no < m.hard_stop) AS stop
    FROM (
      SELECT *, coalesce(lead(block_no) OVER (PARTITION BY file ORDER BY block_no), n_blocks) AS hard_stop
      FROM (
        SELECT b.*, (SELECT coalesce(min(x.block_no), b.n_blocks) FROM eblocks x WHERE x.file = b.file AND x.block_no > b.block_no + 1
            AND NOT (x.starts_with_bold AND regexp_matches(x.text, '^[A-Z][\\p{{L}}\\p{{N}}_ ''/-]+:') AND x.font_size = b.size1)) AS fields_end
        FROM eblocks b
        WHERE {files} AND length(text) <= {title_max} AND NOT starts_with_bold AND NOT regexp_matches(text, '^[A-Z][\\p{{L}}\\p{{N}}_ ''/-]+:')
          AND length(text1) <= {subtitle_max} AND NOT bold1 AND size1 < font_size)
      WHERE fields_end - block_no - 2 >= {min_fields}) m)"""


ENTRIES_SQL = BLOCKS_SQL + r""",
eblocks AS MATERIALIZED (
  SELECT b.*, d.source || '.txt' AS file_name, lead(b.text) OVER w AS text1, lead(starts_with_bold) OVER w AS bold1, lead(font_size) OVER w AS size1,
    count(*) OVER (PARTITION BY file) AS n_blocks
  FROM blocks b JOIN documents d ON d.doc_id = b.file WINDOW w AS (PARTITION BY file ORDER BY block_no)),
defs AS (
  SELECT *, CASE WHEN starts_with_bold AND regexp_matches(text, '^[A-Z][\p{L}\p{N}_ ''/-]*:\s+\S') THEN font_size ELSE -1 END AS mark
  FROM eblocks WHERE file_name IN ('src6.txt', 'src7.txt')),
defruns AS (
  SELECT *, count(*) OVER (PARTITION BY file, run) AS n FROM (
    SELECT *, sum(turn) OVER (PARTITION BY file ORDER BY block_no) AS run FROM (
      SELECT *, (mark IS DISTINCT FROM lag(mark) OVER (PARTITION BY file ORDER BY block_no))::INT AS turn FROM defs))),
matches AS MATERIALIZED (""" + " UNION ALL ".join(
    [
        _statblock_sql("spell", "Spells", "spell_entry", "(file_name LIKE 'src1%.txt' OR file_name = 'src2.txt')", 80, 80, 2),
        _statblock_sql("feat", "Feats", "feat_entry", "file_name IN ('src3.txt', 'src4.txt', 'src5.txt')", 80, 40, 1),
        """ SELECT file, block_no, block_no + 1, block_no + 1, trim(string_split(text, ':')[1]), 'condition', 'Conditions', 'condition_entry', 'definition_list'
  FROM defruns WHERE mark >= 0 AND n >= 2""",
    ]
) + ")"


def matches(spark, sf, found: DataFrame | None = None) -> DataFrame:
    found = blocks(spark, sf) if found is None else found
    return E.find_matches(found.join(D.files(docs(spark, sf)), "file"), D.KINDS)


@query("ent2_matches", f"WITH {ENTRIES_SQL} SELECT * FROM matches")
def ent2_matches(spark, sf):
    return matches(spark, sf)


@query(
    "ent1_eligible_types",
    """SELECT doc_id AS file, 'spell' AS entry_type FROM documents WHERE source LIKE 'src1%' OR source = 'src2'
    UNION ALL SELECT doc_id, 'feat' FROM documents WHERE source IN ('src3', 'src4', 'src5')
    UNION ALL SELECT doc_id, 'condition' FROM documents WHERE source IN ('src6', 'src7')""",
)
def ent1_eligible_types(spark, sf):
    every = D.files(docs(spark, sf))
    parts = [E.eligible(every, k).select("file", F.lit(k.name).alias("entry_type")) for k in D.KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ent5_conflicts",
    f"""WITH {ENTRIES_SQL}, doubled AS (
      SELECT * FROM matches UNION ALL SELECT file, start + 1, fields_end, "end", entry_title, entry_type || '_again', entry_category, entry_chunk_type, shape_family FROM matches WHERE file % 3 = 0),
    following AS (SELECT *, lead(start) OVER w AS next_start, lead(entry_type) OVER w AS next_type FROM doubled WINDOW w AS (PARTITION BY file ORDER BY start, "end", entry_type))
    SELECT file, start, "end", entry_type, next_start, next_type FROM following WHERE next_start < "end" """,
)
def ent5_conflicts(spark, sf):
    found = matches(spark, sf)
    again = found.filter("file % 3 = 0").withColumn("start", F.col("start") + 1).withColumn(
        "entry_type", F.concat("entry_type", F.lit("_again"))
    )
    return E.conflicts(found.unionByName(again))


ANNOTATED_SQL = ENTRIES_SQL + r""",
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY start) - 1 AS entry_index FROM matches),
annotated AS MATERIALIZED (
  SELECT b.*, m.entry_index, m.entry_type, m.entry_category, m.entry_chunk_type, m.entry_title, m.shape_family,
    CASE WHEN m.start IS NULL THEN NULL WHEN m.shape_family = 'definition_list' THEN 'definition' WHEN b.block_no = m.start THEN 'title'
      WHEN b.block_no = m.start + 1 THEN 'subtitle' WHEN b.block_no < m.fields_end THEN 'stat_field' ELSE 'description' END AS entry_role
  FROM blocks b LEFT JOIN numbered m ON b.file = m.file AND b.block_no >= m.start AND b.block_no < m."end")"""


def annotated(spark, sf) -> DataFrame:
    found = blocks(spark, sf)
    return store.stored(E.annotate(found, matches(spark, sf, found)), "annotated")


@query(
    "ent6_annotated",
    f"WITH {ANNOTATED_SQL} SELECT file, block_no, entry_index, entry_type, entry_title, entry_role FROM annotated WHERE entry_index IS NOT NULL",
)
def ent6_annotated(spark, sf):
    return annotated(spark, sf).filter("entry_index is not null").select(
        "file", "block_no", "entry_index", "entry_type", "entry_title", "entry_role"
    )


# --- sections -----------------------------------------------------------------

SECTIONS_SQL = ANNOTATED_SQL + r""",
gaps AS (
  SELECT *, sum(turn) OVER (PARTITION BY file ORDER BY block_no) AS gap FROM (
    SELECT *, (coalesce(entry_index, -1) IS DISTINCT FROM lag(coalesce(entry_index, -1)) OVER (PARTITION BY file ORDER BY block_no))::INT AS turn FROM annotated)),
hruns AS (
  SELECT *, sum(turn2) OVER (PARTITION BY file, gap ORDER BY block_no) AS run FROM (
    SELECT *, (block_type = 'heading_candidate') AS heading,
      ((block_type = 'heading_candidate') IS DISTINCT FROM lag(block_type = 'heading_candidate') OVER (PARTITION BY file, gap ORDER BY block_no))::INT AS turn2
    FROM gaps WHERE entry_index IS NULL)),
hstats AS (SELECT file, gap, run, bool_or(block_type = 'paragraph') AS par, sum(length(text)) AS chars FROM hruns WHERE NOT heading GROUP BY file, gap, run),
cuts AS (
  SELECT r.*, r.heading AND coalesce(s.par AND s.chars >= 40, false) AS boundary
  FROM hruns r LEFT JOIN hstats s ON s.file = r.file AND s.gap = r.gap AND s.run = r.run + 1),
titled AS (
  SELECT c.*, sum(boundary::INT) OVER w AS section,
    coalesce(last(CASE WHEN boundary THEN c.text END IGNORE NULLS) OVER w, d.source) AS section_title
  FROM cuts c JOIN documents d ON d.doc_id = c.file WINDOW w AS (PARTITION BY file, gap ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (
  SELECT *, sum(length(text) + 1) OVER (PARTITION BY file, entry_index ORDER BY block_no) - 1 AS char_end FROM annotated WHERE entry_index IS NOT NULL),
raw_sections AS (
  SELECT file, section_title, NULL AS entry_index, NULL AS entry_category, NULL AS entry_chunk_type, string_agg(text, chr(10) ORDER BY block_no) AS content,
    min(block_no) AS block_start_index, max(block_no) AS block_end_index, first(starts_with_bold ORDER BY block_no) AS title_starts_with_bold,
    count(*) FILTER (block_type = 'paragraph') AS n_paragraph, count(*) FILTER (block_type = 'table_row') AS n_table_row, NULL AS stat_block_end_char
  FROM titled WHERE NOT boundary GROUP BY file, gap, section, section_title
  UNION ALL
  SELECT file, entry_title, entry_index, entry_category, entry_chunk_type, string_agg(text, chr(10) ORDER BY block_no), min(block_no), max(block_no),
    first(starts_with_bold ORDER BY block_no), count(*) FILTER (block_type = 'paragraph'), count(*) FILTER (block_type = 'table_row'),
    max(char_end) FILTER (entry_role = 'stat_field')
  FROM placed GROUP BY file, entry_index, entry_title, entry_category, entry_chunk_type),
sections AS MATERIALIZED (
  SELECT *, length(content) AS body_char_count, row_number() OVER (PARTITION BY file ORDER BY block_start_index) AS section_no,
    coalesce(nullif(regexp_replace(regexp_replace(lower(section_title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS section_slug
  FROM raw_sections)"""


def sections(spark, sf) -> DataFrame:
    files = D.files(docs(spark, sf))
    return S.split_sections(annotated(spark, sf).join(files, "file"))


@query(
    "sec3_sections",
    f"WITH {SECTIONS_SQL} SELECT file, section_no, section_title, section_slug, content, body_char_count, block_start_index, block_end_index, "
    "title_starts_with_bold, n_paragraph, n_table_row, entry_index, stat_block_end_char FROM sections",
)
def sec3_sections(spark, sf):
    return sections(spark, sf).select(
        "file", "section_no", "section_title", "section_slug", "content", "body_char_count", "block_start_index",
        "block_end_index", "title_starts_with_bold", "n_paragraph", "n_table_row", "entry_index", "stat_block_end_char",
    )


DECISIONS_SQL = SECTIONS_SQL + r""",
rated AS (
  SELECT s.*, count(*) OVER (PARTITION BY file) AS n_sections, CASE
    WHEN d.source = 'src9' THEN 'legal_source_passthrough' WHEN entry_index IS NOT NULL THEN 'entry_annotated'
    WHEN section_no = 1 AND body_char_count <= 220 AND (contains(lower(content), 'license') OR contains(lower(content), 'copyright')
      OR (section_slug = coalesce(nullif(regexp_replace(lower(d.source), '[^a-z0-9]+', '_', 'g'), ''), 'unknown') AND body_char_count < 40)) THEN 'boilerplate_opener_stub'
    WHEN contains(section_title, '|') OR starts_with(lower(section_title), 'table:') THEN 'table_label_title'
    WHEN coalesce(title_starts_with_bold, false) AND length(section_title) <= 80 AND regexp_matches(section_title, '^[A-Z][\p{L}\p{N}_ ''/-]+:\s*\S?') THEN 'stat_field_lookalike'
    WHEN n_table_row > 0 AND (n_paragraph < 1 OR body_char_count < 200) THEN 'table_fragment_section'
    WHEN body_char_count < 60 OR NOT regexp_matches(section_title, '[A-Za-z]')
      OR (len(regexp_extract_all(section_title, '[A-Za-z]+')) = 1 AND NOT regexp_matches(regexp_extract(section_title, '[A-Za-z]+'), '^[A-Z]+$') AND length(regexp_extract(section_title, '[A-Za-z]+')) <= 4)
      OR (NOT (len(regexp_extract_all(section_title, '[A-Za-z]+')) = 1 AND regexp_matches(regexp_extract(section_title, '[A-Za-z]+'), '^[A-Z]+$'))
        AND lower(regexp_extract_all(section_title, '[A-Za-z]+')[-1]) IN ('and', 'or', 'the', 'of', 'to', 'for', 'a', 'an')) THEN 'suspicious_short_or_truncated'
    ELSE 'accepted_clean' END AS reason_code
  FROM sections s JOIN documents d ON d.doc_id = s.file),
parted AS (SELECT *, sum((reason_code IN ('legal_source_passthrough', 'entry_annotated', 'accepted_clean'))::INT) OVER (PARTITION BY file ORDER BY section_no) AS part FROM rated),
decisions AS MATERIALIZED (
  SELECT *, CASE WHEN reason_code IN ('legal_source_passthrough', 'entry_annotated', 'accepted_clean') THEN 'accepted' WHEN reason_code = 'boilerplate_opener_stub' AND n_sections = 1 THEN 'dropped'
    WHEN part > 0 AND reason_code <> 'boilerplate_opener_stub' THEN 'merged_backward' ELSE 'merged_forward' END AS action
  FROM parted)"""

BOUNDARY = BoundaryConfig(boilerplate=D.BOILERPLATE)


def decisions(spark, sf) -> DataFrame:
    return S.boundary_decisions(sections(spark, sf).join(D.files(docs(spark, sf)), "file"), BOUNDARY)


@query(
    "sec12_decisions",
    f"""WITH {DECISIONS_SQL},
    heads AS (SELECT file, arg_min(section_title, section_no) AS section_title, sum(body_char_count) + 2 * (count(*) - 1) AS body_char_count, max(n_sections) AS n_sections
      FROM decisions WHERE part = 0 AND action = 'merged_forward' GROUP BY file),
    firsts AS (SELECT file, section_no, reason_code FROM decisions WHERE part = 1 AND action = 'accepted')
    SELECT file, section_no::INT AS section_no, section_title, action, reason_code, body_char_count::INT AS body_char_count FROM decisions
    UNION ALL SELECT h.file, coalesce(f.section_no, h.n_sections + 1)::INT, h.section_title, 'accepted',
      CASE WHEN f.file IS NULL THEN 'forward_bucket_promoted_fallback' ELSE 'forward_bucket_promoted_before_entry' END, h.body_char_count::INT
    FROM heads h LEFT JOIN firsts f ON f.file = h.file WHERE f.file IS NULL OR f.reason_code = 'entry_annotated' """,
)
def sec12_decisions(spark, sf):
    return S.decision_log(store.stored(decisions(spark, sf), "decisions"))


CANON_SQL = DECISIONS_SQL + r""",
homes AS (
  SELECT *, CASE WHEN part = 0 AND max(part) OVER (PARTITION BY file) > 0
      AND NOT bool_or(part = 1 AND reason_code = 'entry_annotated') OVER (PARTITION BY file) THEN 1 ELSE part END AS home,
    CASE WHEN action = 'accepted' THEN 0 ELSE 1 END AS own
  FROM decisions WHERE action <> 'dropped'),
merged AS (
  SELECT file, home, first(section_title ORDER BY own, section_no) AS section_title, first(section_slug ORDER BY own, section_no) AS section_slug,
    first(entry_category ORDER BY own, section_no) AS entry_category, first(entry_chunk_type ORDER BY own, section_no) AS entry_chunk_type,
    first(stat_block_end_char ORDER BY own, section_no) AS stat_block_end_char,
    string_agg(content, chr(10) || chr(10) ORDER BY section_no) AS content, row_number() OVER (PARTITION BY file ORDER BY home) AS section_no
  FROM homes GROUP BY file, home),
canon AS (
  SELECT 'src::' || d.source || '::' || lpad(section_no::VARCHAR, 3, '0') || '_' || section_slug AS document_id, file, section_no,
    CASE WHEN entry_category IS NOT NULL THEN entry_category || ' > ' || section_title ELSE d.source || ' > ' || section_title END AS path,
    CASE WHEN entry_category IS NOT NULL THEN section_title END AS entry_title,
    __FILE_NAME__ || '#' || lpad(section_no::VARCHAR, 3, '0') || '_' || section_slug AS source_location,
    sha1(content) AS source_checksum, length(content) AS n_chars, entry_chunk_type AS chunk_type_hint,
    CASE WHEN entry_category IS NOT NULL AND stat_block_end_char > 0 THEN stat_block_end_char END AS cut_at
  FROM merged m JOIN documents d ON d.doc_id = m.file)""".replace("__FILE_NAME__", FILE_NAME_SQL)


def canonical_sections(spark, sf) -> DataFrame:
    merged = S.merge_sections(decisions(spark, sf))
    return S.canonical_documents(merged, D.files(docs(spark, sf)), "src")


@query("sec14_canonical", f"WITH {CANON_SQL} SELECT * FROM canon")
def sec14_canonical(spark, sf):
    return canonical_sections(spark, sf).select(
        "document_id", "file", "section_no", F.array_join("section_path", " > ").alias("path"), "entry_title",
        "source_location", "source_checksum", F.length("content").alias("n_chars"), "chunk_type_hint", "cut_at",
    )


@query(
    "snk3_report",
    f"WITH {CANON_SQL} SELECT coalesce(chunk_type_hint, 'none') AS kind, count(*) AS n_documents, sum(n_chars) AS n_chars, count(cut_at) AS n_cuts FROM canon GROUP BY 1",
)
def snk3_report(spark, sf):
    return (
        canonical_sections(spark, sf)
        .groupBy(F.coalesce("chunk_type_hint", F.lit("none")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("content")).alias("n_chars"), F.count("cut_at").alias("n_cuts"))
    )


SCHEMA_COMMON = schemas.common(("core", "supplement"), ("primary",))
SCHEMA_DOCUMENT = schemas.canonical((*schemas.HINTS, "subsection"))


@query(
    "sec15_validation",
    f"""WITH {CANONICAL_SQL}, faults AS (
      SELECT document_id, list_sort(list_filter([
        CASE WHEN doc_id % 41 = 0 THEN '$.document_title: type' END,
        CASE WHEN doc_id % 23 = 0 OR content IS NULL THEN '$.content: required' END,
        CASE WHEN doc_id % 37 = 0 THEN '$.note: additionalProperties' END,
        CASE WHEN doc_id % 43 = 0 THEN '$.locator: minProperties' END,
        CASE WHEN doc_id % 31 = 0 AND has_cut THEN '$.processing_hints.structure_cuts[0].char_offset: minimum' END,
        CASE WHEN doc_id % 19 = 0 THEN '$.source_ref.source_id: pattern' END,
        CASE WHEN source_type = 'adventure' THEN '$.source_ref.source_type: enum' END,
        CASE WHEN authority_level <> 'primary' THEN '$.source_ref.authority_level: enum' END], lambda x: x IS NOT NULL)) AS broken FROM canonical)
    SELECT document_id, array_to_string(broken, '|') AS broken FROM faults WHERE len(broken) > 0""",
)
def sec15_validation(spark, sf):
    """All documents as JSON, with faults of seven kinds put into some of them."""
    i = F.col("doc_id")
    gone = lambda c, where: F.when(~where, F.col(c))
    offset = F.transform("cuts", lambda c: F.struct(F.when(i % 31 == 0, -1).otherwise(c["offset"]).alias("offset"), c["type"].alias("type")))
    faulty = D.canonical(docs(spark, sf)).withColumns(
        {
            "source_title": F.lit("Tests"), "content": gone("content", i % 23 == 0), "cuts": offset,
            "section_path": gone("section_path", i % 43 == 0), "source_location": gone("source_location", i % 43 == 0),
            "source_id": F.when(i % 19 == 0, F.upper("source_id")).otherwise(F.col("source_id")),
            "note": F.when(i % 37 == 0, "x"),
        }
    )
    hints = F.struct("chunk_type_hint", F.when(F.size("cuts") > 0, F.transform("cuts", lambda c: F.struct(F.lit("stat_block_end").alias("kind"), c["offset"].alias("char_offset"), c["type"].alias("child_chunk_type")))).alias("structure_cuts"))
    names = {c: c for c in ("document_id", "content", "document_title", "processing_hints", "note")}
    made = schemas.nested(faulty.withColumn("processing_hints", F.when(F.col("chunk_type_hint").isNotNull(), hints)), names)
    number = F.regexp_replace("json", r'"document_title":"doc (\d+)"', '"document_title":$1')
    made = made.withColumn("json", F.when(i % 41 == 0, number).otherwise(F.col("json")))
    found = schemas.broken(made, "document_id", "json", SCHEMA_DOCUMENT, {schemas.COMMON: SCHEMA_COMMON})
    return found.withColumn("broken", F.array_join("broken", "|"))


# --- chunks -------------------------------------------------------------------

_LEGAL = "(contains({0}, 'open game license') OR contains({0}, 'open game content'))"
TYPE_SQL = f"""CASE WHEN len(section_path) = 0 THEN 'generic'
  WHEN {_LEGAL.format("lower(array_to_string(section_path, ' '))")}
    OR list_has_any(regexp_extract_all(lower(array_to_string(section_path, ' ')), '[a-z0-9]+'), ['legal', 'license', 'ogl']) THEN 'generic'
  WHEN {_LEGAL.format("lower(regexp_extract(content, '(?s)^[^.\\n]*[.\\n]?'))")}
    AND length(trim(content[length(regexp_extract(content, '(?s)^[^.\\n]*[.\\n]?')) + 1:], ' ' || chr(10))) < 50 THEN 'generic'
  WHEN len(section_path) = 1 OR regexp_replace(lower(section_path[1]), '[ _-]', '', 'g') = regexp_replace(lower(section_path[-1]), '[ _-]', '', 'g') THEN 'rule_section'
  ELSE 'subsection' END"""

CHUNKS_SQL = CANONICAL_SQL + f""",
parents AS (
  SELECT 'chunk::' || document_id AS chunk_id, document_id, source_id, edition, source_type, authority_level, section_path,
    coalesce(chunk_type_hint, {TYPE_SQL}) AS chunk_type, content, NULL AS parent_chunk_id,
    'chunk::' || lag(document_id) OVER w AS previous_chunk_id, 'chunk::' || lead(document_id) OVER w AS next_chunk_id,
    NULL AS split_origin, 0 AS child_no
  FROM canonical WINDOW w AS (PARTITION BY string_split(source_location, '#')[1] ORDER BY document_id)),
splits AS (SELECT *, CASE WHEN has_cut THEN regexp_replace(content[101:], '^\\n+|\\n+$', '', 'g') ELSE regexp_replace(content, '^\\n+|\\n+$', '', 'g') END AS rest
  FROM canonical WHERE chunk_type_hint IS NOT NULL AND (has_cut OR length(content) > 6000)),
slicing AS (
  WITH RECURSIVE s(document_id, no, piece, rest) AS (
    SELECT document_id, 0, NULL::VARCHAR, rest FROM splits WHERE regexp_matches(rest, '\\S')
    UNION ALL
    SELECT document_id, no + 1, CASE WHEN length(rest) <= 3000 THEN rest ELSE trim(left(rest, cut), chr(10)) END,
      CASE WHEN length(rest) <= 3000 THEN '' ELSE ltrim(rest[cut + drop_n + 1:], chr(10)) END
    FROM (SELECT *, CASE WHEN nl > 0 AND nl >= st THEN nl WHEN st > 0 THEN st + 1 ELSE 3000 END AS cut,
        CASE WHEN nl > 0 AND nl >= st THEN 1 WHEN st > 0 THEN 1 ELSE 0 END AS drop_n
      FROM (SELECT *, CASE WHEN a = 0 THEN -1 ELSE 3000 - a END AS nl, CASE WHEN b = 0 THEN -1 ELSE 3000 - b - 1 END AS st
        FROM (SELECT *, strpos(reverse(left(rest, 3000)), chr(10)) AS a, strpos(reverse(left(rest, 3000)), ' .') AS b FROM s WHERE rest <> '')))
  ) SELECT document_id, no, piece FROM s WHERE piece <> ''),
pieces AS (
  SELECT document_id, 0 AS a, 0 AS b, 'stat_block' AS chunk_type, regexp_replace(left(content, 100), '^\\n+|\\n+$', '', 'g') AS content, 'structure_cut' AS split_origin
  FROM splits WHERE has_cut
  UNION ALL SELECT document_id, 1, no, 'paragraph_group', piece, 'paragraph_group' FROM slicing),
kids AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a, b) AS child_no FROM pieces WHERE content <> ''),
named AS (SELECT *, 'chunk::' || document_id || '::child_' || lpad(child_no::VARCHAR, 3, '0') AS chunk_id FROM kids),
chunks AS MATERIALIZED (
  SELECT * FROM parents UNION ALL
  SELECT n.chunk_id, n.document_id, source_id, edition, source_type, authority_level, section_path, n.chunk_type, n.content, 'chunk::' || n.document_id,
    lag(n.chunk_id) OVER w, lead(n.chunk_id) OVER w, n.split_origin, n.child_no
  FROM named n JOIN canonical c ON c.document_id = n.document_id WINDOW w AS (PARTITION BY n.document_id ORDER BY child_no))"""


def chunks(spark, sf) -> DataFrame:
    return K.build_chunks(D.canonical(docs(spark, sf)), ChunkConfig())


@query(
    "chk13_chunks",
    f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, chunk_type, content, parent_chunk_id, previous_chunk_id, next_chunk_id, split_origin FROM chunks",
)
def chk13_chunks(spark, sf):
    return chunks(spark, sf).select(
        "chunk_id", "document_id", "chunk_type", "content", "parent_chunk_id", "previous_chunk_id", "next_chunk_id", "split_origin"
    )


@query("chk1_chunk_types", f"WITH {CANONICAL_SQL} SELECT document_id, {TYPE_SQL} AS chunk_type FROM canonical")
def chk1_chunk_types(spark, sf):
    return D.canonical(docs(spark, sf)).select(
        "document_id", K.chunk_type(F.col("section_path"), F.col("content")).alias("chunk_type")
    )


@query(
    "chk8_invalid_cuts",
    f"WITH {CANONICAL_SQL} SELECT document_id FROM canonical WHERE (doc_id % 3 = 0 AND length(content) < 400) OR doc_id % 5 = 0",
)
def chk8_invalid_cuts(spark, sf):
    at = lambda n: F.struct(F.lit(n).alias("offset"), F.lit("t").alias("type"))
    cuts = F.when(F.col("doc_id") % 5 == 0, F.array(at(5), at(5))).when(F.col("doc_id") % 3 == 0, F.array(at(0), at(400))).otherwise(F.array(at(0)))
    return K.invalid_cuts(D.canonical(docs(spark, sf)).withColumn("cuts", cuts))


@query(
    "chk10_packing",
    """WITH RECURSIVE paras AS (
      SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
      WHERE regexp_matches(p, '\\S')),
    pack AS (
      SELECT doc_id, i, 1 AS grp, length(p) AS size FROM paras WHERE i = 1
      UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN k.size > 0 AND k.size + length(n.p) > 500 THEN grp + 1 ELSE grp END,
        CASE WHEN k.size > 0 AND k.size + length(n.p) > 500 THEN length(n.p) ELSE k.size + length(n.p) END
      FROM pack k JOIN paras n ON n.doc_id = k.doc_id AND n.i = k.i + 1)
    SELECT k.doc_id, k.grp AS group_no, string_agg(p.p, chr(10) || chr(10) ORDER BY k.i) AS content
    FROM pack k JOIN paras p ON p.doc_id = k.doc_id AND p.i = k.i GROUP BY k.doc_id, k.grp""".replace("\\\\S", "\\S"),
)
def chk10_packing(spark, sf):
    spaced = docs(spark, sf).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    groups = spaced.select("doc_id", F.posexplode(K.pack_paragraphs(F.col("content"), 500)).alias("no", "content"))
    return groups.select("doc_id", (F.col("no") + 1).alias("group_no"), "content")


@query(
    "chk14_validation",
    f"""WITH {CHUNKS_SQL}, faults AS (
      SELECT chunk_id, list_sort(list_filter([
        CASE WHEN length(content) < 60 THEN '$.content: required' END, CASE WHEN source_id = 'src3' THEN '$.chunk_type: enum' END,
        CASE WHEN source_id = 'src5' THEN '$.locator: minProperties' END, CASE WHEN split_origin = 'structure_cut' THEN '$.parent_chunk_id: required' END,
        CASE WHEN source_type = 'adventure' THEN '$.source_ref.source_type: enum' END,
        CASE WHEN authority_level <> 'primary' THEN '$.source_ref.authority_level: enum' END], lambda x: x IS NOT NULL)) AS broken FROM chunks)
    SELECT chunk_id, array_to_string(broken, '|') AS broken FROM faults WHERE len(broken) > 0""",
)
def chk14_validation(spark, sf):
    """All chunks, with faults put into those that have the marks named here."""
    marked = lambda c, fault, none: F.when(fault, none).otherwise(F.col(c))
    source, none = F.col("source_id"), F.lit(None).cast("string")
    faulty = chunks(spark, sf).withColumns(
        {
            "source_title": F.lit("Tests"),
            "content": marked("content", F.length("content") < 60, none),
            "chunk_type": marked("chunk_type", source == "src3", F.lit("no_such_type")),
            "section_path": marked("section_path", source == "src5", F.lit(None).cast("array<string>")),
            "parent_chunk_id": marked("parent_chunk_id", F.col("split_origin") == "structure_cut", none),
        }
    ).drop("source_location", "entry_title")
    found = schemas.broken_chunks(faulty, None, {schemas.COMMON: SCHEMA_COMMON})
    return found.withColumn("broken", F.array_join("broken", "|"))


@query(
    "snk5_chunk_report",
    f"WITH {CHUNKS_SQL} SELECT chunk_type, count(*) AS n, count(*) FILTER (parent_chunk_id IS NULL) AS n_parents, count(*) FILTER (split_origin = 'structure_cut') AS n_cut, "
    "count(*) FILTER (split_origin = 'paragraph_group') AS n_grouped, max(length(content)) AS longest FROM chunks GROUP BY chunk_type",
)
def snk5_chunk_report(spark, sf):
    return chunks(spark, sf).groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("parent_chunk_id").isNull()).alias("n_parents"),
        F.count_if(F.col("split_origin") == "structure_cut").alias("n_cut"),
        F.count_if(F.col("split_origin") == "paragraph_group").alias("n_grouped"),
        F.max(F.length("content")).alias("longest"),
    )


@query(
    "corpus_length_quantiles",
    f"WITH {CHUNKS_SQL} SELECT min(length(content)) AS p0, quantile_cont(length(content), 0.25) AS p25, quantile_cont(length(content), 0.5) AS p50, "
    "quantile_cont(length(content), 0.75) AS p75, quantile_cont(length(content), 0.99) AS p99, max(length(content)) AS p100 FROM chunks",
)
def corpus_length_quantiles(spark, sf):
    n = F.length("content")
    return chunks(spark, sf).agg(
        F.min(n).alias("p0"), F.percentile(n, 0.25).alias("p25"), F.percentile(n, 0.5).alias("p50"),
        F.percentile(n, 0.75).alias("p75"), F.percentile(n, 0.99).alias("p99"), F.max(n).alias("p100"),
    )


# --- terms --------------------------------------------------------------------

_PHRASE = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(lower({0}), 'ß', 'ss'), '_-', '  '), '\([^)]*\)', ' ', 'g'), '[^a-z0-9\s/]', ' ', 'g'), '\s+', ' ', 'g'))"""
_ACCEPT = r"""(phrase <> '' AND phrase NOT IN ('open game license', 'terms of use', 'privacy policy', 'legal information', 'table below')
  AND len(string_split(phrase, ' ')) BETWEEN 2 AND 5 AND NOT regexp_matches(phrase, '^[0-9]')
  AND string_split(phrase, ' ')[1] NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'for', 'in', 'on', 'by', 'from', 'with', 'without', 'at')
  AND NOT list_has_any(string_split(phrase, ' '), ['license', 'copyright']) AND NOT contains(phrase, 'spell list') AND NOT contains(phrase, 'power list'))"""
TERMS_SQL = f"""{CANONICAL_SQL},
titles AS (SELECT DISTINCT phrase FROM (
  SELECT {_PHRASE.format("t")} AS phrase FROM (SELECT unnest(list_concat([document_title], section_path[2:])) AS t FROM canonical)) WHERE {_ACCEPT}),
counts AS (SELECT phrase, count(*) AS n FROM (
  SELECT {_PHRASE.format("r")} AS phrase FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(content), '[a-z0-9_]*[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{24F}}0-9_][\\p{{L}}\\p{{N}}_]*', '#', 'g'), '\\b[a-z][a-z]+(?: [a-z][a-z]+){{1,4}}\\b')) AS r FROM canonical)) WHERE {_ACCEPT} GROUP BY phrase)"""


@query("trm3_title_terms", f"WITH {TERMS_SQL} SELECT phrase FROM titles")
def trm3_title_terms(spark, sf):
    return R.title_terms(D.canonical(docs(spark, sf)))


@query("trm4_content_terms", f"WITH {TERMS_SQL} SELECT phrase, n FROM counts")
def trm4_content_terms(spark, sf):
    return R.content_terms(D.canonical(docs(spark, sf)))


@query(
    "trm5_term_buckets",
    f"""WITH {TERMS_SQL}, keyed AS (SELECT phrase FROM titles UNION SELECT phrase FROM counts WHERE n >= 3 AND
      list_has_any(string_split(phrase, ' '), string_split('{" ".join(__import__("folioscan.config", fromlist=["x"]).TERM_KEYWORDS)}', ' ')))
    SELECT coalesce(k.phrase, c.phrase) AS phrase, k.phrase IS NOT NULL AS is_protected, c.phrase IS NOT NULL AS is_content
    FROM keyed k FULL JOIN (SELECT phrase FROM counts WHERE n >= 4) c ON c.phrase = k.phrase""",
)
def trm5_term_buckets(spark, sf):
    every = D.canonical(docs(spark, sf))
    return R.term_buckets(R.title_terms(every), R.content_terms(every))
