"""DuckDB SQL for the operators that SQL can express."""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _line_dedup(table: str, min_sites: int = 10) -> str:
    """``doc_id, n_lines, n_removed, cleaned`` of every row of ``table``."""
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS rid, * FROM {table}),
pieces AS (SELECT rid, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered WHERE text IS NOT NULL),
lines AS (SELECT rid, site, pos, raw, trim(raw, {_WS}) AS line FROM pieces),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
mostly AS (SELECT rid FROM lines GROUP BY rid
           HAVING coalesce(sum(length(line)) FILTER (WHERE line IN (SELECT line FROM spread)), 0) > 0.5 * sum(length(line))),
carried AS (SELECT line FROM lines WHERE line IN (SELECT line FROM spread) AND rid NOT IN (SELECT rid FROM mostly)
            GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
marked AS (SELECT *, CASE WHEN rid IN (SELECT rid FROM mostly) THEN line IN (SELECT line FROM carried) ELSE line IN (SELECT line FROM spread) END AS hit FROM lines),
per_doc AS (SELECT rid, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE hit) AS hits,
                   coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS rest FROM marked GROUP BY rid)
SELECT n.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.hits, 0)::BIGINT AS n_removed,
       CASE WHEN p.hits > 0 THEN p.rest ELSE n.text END AS cleaned
FROM numbered n LEFT JOIN per_doc p USING (rid)"""


def op1() -> str:
    from evidentia.llm.quality_rules import RULES, STOP_WORDS

    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    rules = " AND ".join(
        f"NOT ({' OR '.join([f'100.0 * {r.numerator} {op} {v} * {r.denominator}' for op, v in (('<', r.low), ('>', r.high)) if v is not None])})"
        for r in RULES
    )
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS ls FROM documents),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(t) - length(translate(t, '!?', '')))::BIGINT AS n_marks,
             len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules}) AS kept FROM s"""


def op2() -> str:
    return f"SELECT doc_id, n_lines, n_removed, sha256(cleaned) AS text_sha256 FROM ({_line_dedup('documents')})"


def op12(levels: int = 16, group_levels: int = 12) -> str:
    """The tree level by level: enough levels for 3**16 rows of a source and 3**12 sources."""
    fields = lambda text: ["doc_id", "source", "lang", "n_chars", text]
    leaf = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in fields(text)) + ")"
    # crc32 of the decimal digits, bit by bit; only its last bit is asked for.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    steps = []
    for tree, last, name in (("n", levels, "p"), ("t", group_levels, "q")):
        if tree == "t":
            steps.append(f"t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS name FROM n{levels})")
            steps.append(f"q0 AS MATERIALIZED (SELECT p.rid, '' AS g, t0.i, p.folded, p.siblings FROM p{levels} p JOIN t0 ON p.g = t0.name)")
        for k in range(last):
            steps.append(f"{tree}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + 2) // 3 AS n FROM {tree}{k} GROUP BY g, i // 3)")
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT p.rid, p.g, p.i // 3 AS i, p.siblings || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE s.i <> p.i), '') AS siblings,
    CASE WHEN max(s.n) = 1 THEN p.folded ELSE sha256(string_agg(CASE WHEN s.i = p.i THEN p.folded ELSE s.d END, '' ORDER BY s.i)) END AS folded
    FROM {name}{k} p JOIN {tree}{k} s ON s.g = p.g AND s.i // 3 = p.i // 3 GROUP BY p.rid, p.g, p.i, p.siblings, p.folded)""")
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, *, doc_id IS NOT NULL AND {crc} % 2 = 0 AS tampers FROM documents),
leaves AS MATERIALIZED (SELECT rid, doc_id, coalesce('=' || source, '-') AS g, {leaf("text")} AS d,
    CASE WHEN tampers THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS shown FROM rows_),
n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d, rid) - 1 AS i, d, count(*) OVER (PARTITION BY g) AS n, rid, shown FROM leaves),
p0 AS MATERIALIZED (SELECT rid, g, i, '' AS siblings, shown AS folded FROM n0),
{", ".join(steps)}
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(q.siblings) AS proof_sha256, q.folded AS folded_root, q.folded = r.d AS verified
FROM leaves l JOIN n{levels} s ON s.g = l.g JOIN q{group_levels} q ON q.rid = l.rid CROSS JOIN t{group_levels} r"""


def op13() -> str:
    return """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
fine AS MATERIALIZED (SELECT rid, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM v
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM fine a JOIN fine b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
met AS (SELECT rid, rid AS other FROM v UNION SELECT met.rid, links.b FROM met JOIN links ON links.a = met.other),
parts AS (SELECT met.rid, min(v.vec_id) AS component_id FROM met JOIN v ON v.rid = met.other GROUP BY met.rid),
counts AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, p.component_id, coalesce(v.vec_id = p.component_id, p.component_id IS NULL) AS kept
FROM v JOIN parts p USING (rid) LEFT JOIN counts c USING (rid)"""


ORACLE_SQL = {"op1_quality_rules": op1(), "op2_line_dedup": op2(), "op12_merkle_manifest": op12(), "op13_embedding_near_dedup": op13()}
