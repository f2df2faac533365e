"""SQL twins of the derived inputs and small helpers to write the checking statements (DuckDB dialect)."""

from __future__ import annotations

import re

from paperloom import vocab as v
from paperloom.functions.headings import FAMILIES, heading_alternation

# --- fixed values: texts written into the derived inputs ------------------------------------------------------
HEADINGS = [
    "# Abstract\n", "## 1. Introduction\n", "## Results\n", "# Table 1 Performance\n", "## References\n",
    "Experimental Section\n", "3. Methods\n", "Conclusions\n", "## Device Fabrication\n", "# 2. Discussion\n", "", "", "",
    "", "", "", "",
]
MEASUREMENTS = [
    " PCE 1{d}.{d} % and V_oc 0.9 V, 2{d} mA higher than the ITO reference.",
    " Films were annealed at 10{d} °C by thermal annealing; spin coating gave $1 9 . {d} 0 \\%$ [1] (2021).",
    " The MAPbI3 perovskite has a band gap of 1.{d} eV and a fill factor better than silicon, using vacuum vapor-diffusion method.",
    " Smith, J. et al. vol. 3 pp. 1{d} (2019) [2], doi: 10.1/{d}; a random forest predicts degradation.",
    "",
]
STEMS = [
    "What is the PCE of a red widget and how much does it reach?",
    "How does ITO affect the small ring film?",
    "Compare the Voc of blue bolt versus green gear devices, which is higher?",
    "Latest 2025 reports on MAPbI3 and cheap gadget stability?",
    "Why are perovskite layers annealed by a spin method?",
    "When was the large widget measured?",
    "Define the fill factor FF and explain its meaning.",
    "List devices.",
]
MODELS = ["model_a", "model_b", "model_c", "model_d", "model_e"]
SECTION_CYCLE = ["results", "discussion", "methodology", "performance", "default"]


def s(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def case(expr: str, options: list, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {s(o) if isinstance(o, str) else o}" for i, o in enumerate(options))
    return f"CASE {expr} {arms} ELSE {default} END"


def strip(x: str) -> str:
    return f"trim({x}, {s(v.STRIP_CHARS)})"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {s(w)})" for w in words) + ")"


def matches(x: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, {s(flags + pattern)})"


def find_all(x: str, pattern: str, group: int = 0, flags: str = "(?i)") -> str:
    return f"regexp_extract_all({x}, {s(flags + pattern)}, {group})"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {s(pattern)}, {s(replacement)}, 'g')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def concat_lists(parts: list[str]) -> str:
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, {s(sep)})"


def cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def _labels(i: str) -> str:
    return (
        f"{case(f'{i} % 8', v.QA_CATEGORIES)} AS category, {case(f'{i} % 3', v.DIFFICULTIES)} AS difficulty, "
        f"{case(f'{i} % 2', v.REASONING_TYPES)} AS reasoning"
    )


def _value(j: int) -> str:
    q, m, k = "item_id", "m", "k"
    return (
        f"CASE WHEN ({q} + {m} + {j}) % 11 = 0 THEN NULL WHEN ({q} + {j} + {k}) % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE "
        f"CAST(({q} * 7 + {m} * 13 + {k} * 17 + {j} * 5 + {q} * {m} * 3) % 101 AS DOUBLE) / 100 END AS {v.METRICS[j]}"
    )


def family_case(title: str) -> str:
    arms = " ".join(f"WHEN {matches(title, '^' + v.heading_pattern(f))} THEN {s(f)}" for f in FAMILIES)
    return f"CASE {arms} ELSE 'default' END"


def config_case(section: str, index: int) -> str:
    arms = " ".join(
        f"WHEN {s(r[0])} THEN {s(r[index]) if isinstance(r[index], str) else r[index]}" for r in v.SECTION_CONFIG
    )
    return f"CASE {section} {arms} END"


OPEN, CLOSE = "﷐", "﷑"
_notes = [f"replace({s(m)}, '{{d}}', CAST(doc_id % 10 AS VARCHAR))" for m in MEASUREMENTS]
_note_case = "CASE (doc_id + i - 1) % 5 " + " ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(_notes)) + " END"

# name -> statement; a statement may read supplied tables and entries above it
CTES: dict[str, str] = {
    "papers": f"""SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)),
        lambda l, i: concat({case('(doc_id + i - 1) % 17', HEADINGS)}, l, {_note_case})), chr(10)) AS text FROM documents""",
    "pieces": f"""SELECT doc_id, string_split(regexp_replace(text, {s('(?im)' + heading_alternation())}, {s(OPEN + chr(92) + '0' + CLOSE)}, 'g'), {s(OPEN)}) AS p,
        text FROM papers""",
    "bodies": f"""SELECT doc_id, unnest(list_transform(p[2:], lambda x, i: struct_pack(no := i, body := x))) AS b FROM pieces WHERE len(p) > 1""",
    "sections": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS section_no, section_type, section_title, text FROM (
        SELECT doc_id, 0 AS no, 'default' AS section_type, {s(v.WHOLE_TEXT_TITLE)} AS section_title, text FROM pieces WHERE len(p) = 1
        UNION ALL SELECT doc_id, 0, 'default', {s(v.PREAMBLE_TITLE)}, {strip('p[1]')} FROM pieces WHERE len(p) > 1 AND length({strip('p[1]')}) >= 50
        UNION ALL SELECT doc_id, b.no, {family_case("split_part(b.body, " + s(CLOSE) + ", 1)")}, {strip("split_part(b.body, " + s(CLOSE) + ", 1)")},
        {strip("replace(b.body, " + s(CLOSE) + ", '')")} FROM bodies WHERE length({strip("replace(b.body, " + s(CLOSE) + ", '')")}) >= 50)""",
    "cuts": f"""SELECT doc_id, section_no, section_type, section_title, text, length(text) AS n, {config_case('section_type', 2)} AS size,
        {config_case('section_type', 3)} AS overlap FROM sections WHERE section_type <> 'references'""",
    "spans": f"""SELECT *, start + 1 AS a, least(start + size, n) AS stop FROM (
        SELECT *, unnest(CASE WHEN n <= size THEN [0::BIGINT] ELSE range(0, n, size - overlap) END) AS start FROM cuts)""",
    "windows": f"""SELECT *, {strip('substring(text, a::BIGINT, (stop - start)::BIGINT)')} AS content FROM spans
        WHERE n <= size OR length({strip('substring(text, a::BIGINT, (stop - start)::BIGINT)')}) > 0""",
    "passages": f"""SELECT doc_id, row_number() OVER d - 1 AS global_chunk_id, count(*) OVER (PARTITION BY doc_id) AS total_chunks, content, section_type, section_title,
        {config_case('section_type', 4)} AS section_name, {config_case('section_type', 1)} AS section_priority,
        row_number() OVER sec - 1 AS section_chunk_id, count(*) OVER (PARTITION BY doc_id, section_no) AS section_chunks_count,
        CASE WHEN n <= size THEN n ELSE length(content) END AS chunk_size, (CASE WHEN n <= size THEN n ELSE length(content) END) // 4 AS token_count,
        n <= size AS is_complete_section, start AS chunk_start_pos, stop AS chunk_end_pos, size AS configured_chunk_size, overlap AS configured_overlap
        FROM windows WINDOW d AS (PARTITION BY doc_id ORDER BY section_no, start), sec AS (PARTITION BY doc_id, section_no ORDER BY start)""",
    "questions": f"SELECT item_id, concat({case('item_id % 8', STEMS)}, ' ', text) AS question FROM benchmark",
    "eval_runs": f"""SELECT {case('m', MODELS)} AS model, {case('k', v.MODES)} AS mode, item_id AS question_id, {_labels('item_id')},
        text AS question, CASE (item_id + m + k * 5) % 19 WHEN 0 THEN '' WHEN 1 THEN 'Error: no answer' ELSE text || ' [Sources: 2 vector docs]' END AS answer,
        CASE WHEN item_id % 6 = 0 THEN '' ELSE text END AS ground_truth,
        CASE (item_id + m * 3 + k) % 17 WHEN 0 THEN 'HTTP 429 Rate Limit' WHEN 1 THEN 'Connection timeout' WHEN 2 THEN 'bad value' END AS error,
        CAST((item_id * 31 + m * 7 + k) % 300 AS DOUBLE) AS response_time, CAST(1 + (item_id + m + k) % 3 AS INTEGER) AS iterations,
        CAST((item_id * 11 + m * 3 + k) % 101 AS DOUBLE) / 100 AS quality_score, CAST((item_id + m) % 5 AS INTEGER) AS n_contexts,
        {', '.join(_value(j) for j in range(6))}
        FROM benchmark, range(5) AS tm(m), range(3) AS tk(k)""",
    "eval_long": f"""SELECT model, mode, question_id, category, difficulty, reasoning, metric, value FROM (
        {' UNION ALL '.join(f"SELECT *, {s(x)} AS metric, {x} AS value FROM eval_runs" for x in v.METRICS)})""",
    "question_vectors": "SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id",
    "scored": """SELECT q.query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity
        FROM question_vectors q, embeddings e""",
    "neighbours": """SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
        FROM scored QUALIFY rank <= 20""",
    "contexts": f"""SELECT n.query_id, n.vec_id AS doc_id, n.rank, n.similarity,
        CASE WHEN n.vec_id % 2 = 0 THEN CAST((n.vec_id * 37 + n.query_id * 11) % 1000 AS DOUBLE) / 1000 END AS rerank_score,
        {case('n.vec_id % 4', ['vector', 'web:arxiv', 'neo4j', 'report.pdf'])} AS source, {case('n.vec_id % 5', SECTION_CYCLE)} AS section_type,
        n.vec_id % 3 = 0 AS has_numerical_data, d.text AS content FROM neighbours n JOIN documents d ON d.doc_id = n.vec_id""",
    "device_records": f"""SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INTEGER, {cents('l_extendedprice')}, {cents('l_discount')},
        {cents('l_tax')}, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS record_id, '10.1000/' || CAST(l_orderkey % 997 AS VARCHAR) AS doi,
        p_name AS donor_name, p_brand AS acceptor_name, CASE WHEN l_linenumber % 3 = 0 THEN p_type END AS additive_id,
        CASE WHEN l_linenumber <> 1 THEN s_name END AS donor_smiles, CASE WHEN l_linenumber <> 2 THEN p_type END AS donor_type,
        l_quantity AS donor_conc, {cents('l_discount')}::DOUBLE AS pce_percent, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS jsc_ma_cm2,
        {cents('l_tax')}::DOUBLE AS voc_v, CASE WHEN l_returnflag <> 'N' THEN CAST(0.7 AS DOUBLE) END AS ff
        FROM (SELECT DISTINCT * FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "raw_entities": """SELECT CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-')
        WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END AS name,
        CASE WHEN p_partkey % 5 = 0 THEN 'Process' ELSE 'Material' END AS type, p_brand || ' used as ' || lower(p_type) AS description,
        'paper_' || CAST(l_orderkey % 211 AS VARCHAR) AS paper, 'brand' AS prop_key, p_brand AS prop_value, (l_quantity::BIGINT + 50)::DOUBLE / 100 AS confidence,
        concat_ws('|', lpad(l_orderkey::VARCHAR, 12, '0'), lpad(l_partkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR) AS seq
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem) JOIN part ON l_partkey = p_partkey""",
    "raw_relations": """SELECT 'S' || l_suppkey AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN 'USES' ELSE 'CONTAINS' END AS type, 'P' || l_partkey AS target_id,
        'flag ' || l_returnflag AS description, 'paper_' || CAST(l_orderkey % 211 AS VARCHAR) AS paper, (l_quantity::BIGINT + 50)::DOUBLE / 100 AS confidence
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity FROM lineitem)""",
    "vertices": """SELECT 'N' || n_nationkey AS id, n_name AS name, 'Nation' AS type, 'nation of region ' || n_regionkey AS description FROM nation
        UNION ALL SELECT 'S' || s_suppkey, s_name, 'Supplier', 'supplier of parts' FROM supplier
        UNION ALL SELECT 'P' || p_partkey, p_name, 'Part', p_brand || ' ' || lower(p_type) FROM part""",
    "edges": """SELECT 'S' || s_suppkey AS source_id, 'LOCATED_IN' AS type, 'N' || s_nationkey AS target_id FROM supplier
        UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'SUPPLIES', 'P' || l_partkey FROM lineitem""",
    "qa_pairs": f"""SELECT 'paper_' || u.conv_id AS paper_id, u.conv_id, u.turn AS pos, u.text AS question, a.text AS answer,
        CASE WHEN (u.conv_id + u.turn) % 9 = 8 THEN 'stability' WHEN (u.conv_id + u.turn) % 9 = 7 THEN 'unknown area' ELSE {case('(u.conv_id + u.turn) % 8', v.QA_CATEGORIES)} END AS category,
        CASE WHEN (u.conv_id + u.turn) % 4 = 3 THEN 'extreme' ELSE {case('(u.conv_id + u.turn) % 4', v.DIFFICULTIES)} END AS difficulty,
        CASE WHEN (u.conv_id + u.turn) % 3 = 2 THEN NULL ELSE {case('(u.conv_id + u.turn) % 3', v.REASONING_TYPES)} END AS reasoning_type
        FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
}


def with_inputs(sql: str, **extra: str) -> str:
    """Put the needed inputs, and any given named statements, in front of a statement."""
    known = {**CTES, **extra}
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(known[name])

    visit(sql)
    order = [n for n in known if n in need]
    # named statements may use each other only in the order given
    return ("WITH " + ", ".join(f"{n} AS ({known[n]})" for n in order) + " " if order else "") + sql
