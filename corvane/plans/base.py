"""Registration of named queries, and SQL fragments that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under a name, with its DuckDB SQL."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences(x: str) -> str:
    found = rf"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]+\s?|[^.!?]+$'), lambda s: {trim('s')}), lambda s: s <> '')"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{x}] END"


def terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda s: s <> '')"


def word_set(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda s: s <> ''))"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: WITH clause: lines, paras, sents (the corpus views).
CORPUS = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
paras AS (SELECT doc_id, source, para, pos, (pos // 20 + 1)::INT AS page_num, 'p' || (pos // 20 + 1) || '_para' || (pos % 20 + 1) AS paragraph_id FROM lines WHERE regexp_matches(para, '\S')),
split AS (SELECT doc_id, source, pos, page_num, paragraph_id, {sentences('para')} AS s FROM paras),
each AS (SELECT doc_id, source, pos, page_num, paragraph_id, unnest(s) AS text, generate_subscripts(s, 1) AS k FROM split),
sents AS (SELECT doc_id || '_' || paragraph_id || '_s' || k AS id, doc_id, source, page_num, paragraph_id, paragraph_id || '_s' || k AS sentence_id, text,
  coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset_start FROM each)
"""
