"""Settings of the engine, as frozen dataclasses, and fixed values."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from string import ascii_lowercase

# Score boosts (subtracted; lower scores are better) and priors by chunk type.
PATH_BOOST, EXACT_BOOST, PROTECTED_BOOST, OVERLAP_BOOST = 2.0, 1.5, 1.0, 0.1
TYPE_PRIOR = {
    "rule_section": 1.0,
    "class_feature": 0.8,
    "feat_entry": 0.6,
    "skill_entry": 0.6,
    "spell_entry": 0.6,
    "condition_entry": 0.6,
    "stat_block": 0.6,
    "subsection": 0.5,
    "errata_note": 0.4,
    "table": 0.3,
    "faq_note": 0.3,
    "glossary_entry": 0.3,
    "paragraph_group": 0.2,
    "example": 0.1,
    "sidebar": 0.1,
    "generic": 0.0,
}
# BM25.
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
# The texts of an abstention, by trigger.
ABSTAIN = {
    "empty_evidence": "Insufficient evidence: no chunks retrieved for this query.",
    "weak_signals": "Insufficient evidence: retrieved chunks do not clearly match the query.",
}
# Failure tags in the order of reports.
TAGS = (
    "retrieval_miss",
    "wrong_section",
    "wrong_entry",
    "citation_mismatch",
    "unsupported_inference",
    "missing_abstain",
    "unnecessary_abstain",
    "edition_boundary_failure",
)
# Words that begin a question.
QUESTION_WORDS = ("what", "how", "when", "where", "why", "who", "which")
# Words left out of evaluation tokens.
EVAL_STOP_WORDS = (
    "a an the is are was were be been being do does did doing have has had having of in on at to for "
    "with by from and or but not no if then else i you he she it we they this that what when where who "
    "why how which can could would should may might must shall will"
).split()
# Term mining.
TERM_STOP_PHRASES = ("open game license", "terms of use", "privacy policy", "legal information", "table below")
TERM_STOP_WORDS = "the a an and or of to for in on by from with without at".split()
TERM_KEYWORDS = (
    "ability armor attack bonus caster challenge class combat damage difficulty feat grapple hit initiative "
    "level power range resistance save saving skill spell turn undead weapon"
).split()
# Legal paths and openings.
LEGAL_TOKENS = ("legal", "license", "ogl")
LEGAL_PHRASES = ("open game license", "open game content")
# Last words of cut-off titles.
TRUNCATED_SUFFIXES = ("and", "or", "the", "of", "to", "for", "a", "an")


def _folds() -> tuple[str, str]:
    """Lower-case letters with one mark over a letter of a to z, and those letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0] in ascii_lowercase and unicodedata.combining(parts[1]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters with marks and what they fold to, for index terms.
FOLD_FROM, FOLD_TO = _folds()


def _case_folds() -> dict[str, str]:
    """Lower-case letters that full case folding still changes."""
    letters = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1F000)))
    return {c: c.casefold() for c in letters if c == c.lower() != c.casefold()}


#: For full case folding behind lower-casing.
CASE_FOLDS = _case_folds()


@dataclass(frozen=True)
class BlockConfig:
    heading_min: int = 3
    heading_max: int = 90
    heading_words: int = 12
    heading_share: float = 0.7
    section_chars: int = 40


@dataclass(frozen=True)
class BoundaryConfig:
    short: int = 60
    stub_max: int = 220
    stem_stub_min: int = 40
    fragment: int = 200
    lookalike_title: int = 80
    boilerplate: tuple[str, ...] = ()
    #: Fixed value: names, in lower case, of files that are legal texts.
    legal_files: tuple[str, ...] = ("legal.rtf",)


@dataclass(frozen=True)
class ChunkConfig:
    """Positive whole numbers, in characters."""

    threshold: int = 6000
    target: int = 2000
    maximum: int = 3000
    version: str = "v2-formatting-aware"

    def __post_init__(self) -> None:
        for name in ("threshold", "target", "maximum"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive whole number, got {value!r}")

    @classmethod
    def of(cls, raw: dict | None) -> ChunkConfig:
        """From a mapping with the names of a settings file; unknown keys are left out."""
        names = {
            "child_threshold_chars": "threshold",
            "paragraph_group_target_chars": "target",
            "paragraph_group_max_chars": "maximum",
        }
        return cls(**{names[k]: v for k, v in (raw or {}).items() if k in names})


@dataclass(frozen=True)
class EntryType:
    """A kind of entry: shape is entry_with_statblock or definition_list."""

    name: str
    category: str
    chunk_type: str
    shape: str
    files: tuple[str, ...] | None = None
    title_max: int = 80
    subtitle_max: int = 80
    min_fields: int = 2
    min_blocks: int = 3
    pattern: str = ""

    @classmethod
    def of(cls, raw: dict) -> EntryType:
        """From an entry of a content-type registry; unknown parameters are left out."""
        names = {"max_title_len": "title_max", "max_subtitle_len": "subtitle_max", "min_fields": "min_fields", "min_blocks": "min_blocks"}
        given = raw.get("shape_params") or {}
        more = {names[k]: v for k, v in given.items() if k in names}
        pattern = given.get("field_pattern") or given.get("term_pattern") or ""
        files = raw.get("file_match")
        if "\\w" in pattern and not pattern.startswith("(?"):
            pattern = "(?U)" + pattern  # word characters of any script
        return cls(raw["name"], raw["category"], raw["chunk_type"], raw["shape"], tuple(files) if files is not None else None, pattern=pattern, **more)


@dataclass(frozen=True)
class TermAssets:
    """aliases are applied in order; phrases and surface variants stay whole in tokens."""

    aliases: dict[str, str] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()


@dataclass(frozen=True)
class Constraints:
    editions: tuple[str, ...]
    source_types: tuple[str, ...]
    authority_levels: tuple[str, ...]
    excluded: tuple[str, ...] = ()

    @classmethod
    def of(cls, registry: list[dict], excluded: tuple[str, ...] = ()) -> Constraints:
        """Admitted values of a source registry: all rows but planned ones."""
        rows = [r for r in registry if r.get("status") != "planned_later"]
        pick = lambda k: tuple(sorted({r[k] for r in rows if r.get(k)}))
        return cls(pick("edition"), pick("source_type"), pick("authority_level"), tuple(excluded))
