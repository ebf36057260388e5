"""SQL twins of the analysers, for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from tarnwick.functions import words as W

CHUNKS = "chunks AS (SELECT DISTINCT ON (chunk_key) * FROM text_chunk)"
CANDIDATES = "candidates AS (SELECT * FROM retrieved_chunk QUALIFY row_number() OVER (PARTITION BY qid, chunk_key ORDER BY ingested_at DESC) = 1)"
VECTORS = "vectors AS (SELECT DISTINCT ON (vec_key) * FROM document_chunks)"
FILES = "files AS (SELECT * FROM pdf_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC) = 1)"
AUDIT = "audit AS (SELECT * FROM audit_logs QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
PAGES = "pages AS (SELECT * FROM page_text QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC) = 1)"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def stem(word: str, rules: Sequence[W.Suffix], otherwise: str | None = None) -> str:
    out = "CASE"
    for r in rules:
        ends = "(" + " OR ".join(f"{word} LIKE '%{e}'" for e in r.ends) + ")"
        unless = "".join(f" AND {word} NOT LIKE '%{e}'" for e in r.unless)
        out += f" WHEN length({word}) > {r.longer} AND {ends}{unless} THEN left({word}, length({word}) - {r.drop}) || '{r.add}'"
    return f"{out} ELSE {otherwise or word} END"


def tokens(text: str, pattern: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{pattern}')"


def distinct_in_order(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def terms_v5(text: str) -> str:
    bare = f"list_transform({tokens(text, '[a-z0-9][a-z0-9_./:#-]*')}, lambda t: regexp_replace(t, '[^a-z0-9]+', '', 'g'))"
    kept = f"list_filter({bare}, lambda t: t != '' AND NOT list_contains({listed(W.STOP_V5)}, t))"
    stems = f"list_transform({kept}, lambda t: {stem('t', W.STEM_V5)})"
    return f"list_slice({distinct_in_order(stems)}, 1, 40)"


def terms_smart(text: str) -> str:
    kept = f"list_filter({tokens(text, '[a-z0-9]+')}, lambda t: NOT list_contains({listed(W.STOP_SMART)}, t))"
    stems = f"list_transform({kept}, lambda t: {stem('t', W.STEM_SMART)})"
    return f"list_distinct(list_filter({stems}, lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]+')))"


def priority_terms(text: str) -> str:
    terms = terms_smart(text)
    best = f"list_filter({terms}, lambda t: NOT list_contains({listed(W.LOW_SIGNAL)}, t) AND NOT regexp_full_match(t, '[0-9]+') AND length(t) > 2)"
    return f"CASE WHEN len({best}) > 0 THEN {best} ELSE list_filter({terms}, lambda t: NOT regexp_full_match(t, '[0-9]+')) END"


def bm25_tokens(text: str) -> str:
    found = tokens(text, "[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_./:#-]*[\\p{L}\\p{N}_])?")
    return f"list_filter({found}, lambda t: length(t) > 1 AND NOT list_contains({listed(W.STOP_BM25)}, t))"


def canonical_phrase(text: str) -> str:
    cases = " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate(W.NUMBER_WORDS))
    return f"array_to_string(list_transform({tokens(text, '[a-z0-9]+')}, lambda t: CASE t {cases} ELSE t END), ' ')"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"
