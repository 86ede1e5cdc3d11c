"""The queries of this package that DuckDB SQL can express."""

from __future__ import annotations

from flipside.llm import perspective



def field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(field(value) for value in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def crc32(text: str) -> str:
    """Bit by bit: every byte is followed by eight shifts, which -1 stands for."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: {step}), CAST(4294967295 AS BIGINT))"


def merkle_levels(name: str, base: str, key: str) -> str:
    """All levels of the trees of ``base (key, rank, n, digest)``, the lowest being 0."""
    return f"""{name} AS (
        SELECT {key}, 0 AS level, rank, n, digest FROM {base}
        UNION ALL
        SELECT {key}, level + 1, rank // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank))
        FROM {name} WHERE n > 1 GROUP BY {key}, level, rank // 3, n
    )"""


def merkle_paths(name: str, levels: str, key: str) -> str:
    """Per leaf and level: the siblings left and right."""
    return f"""{name} AS (
        SELECT a.{key}, a.rank AS leaf_rank, b.level,
               coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank // CAST(pow(3, b.level) AS BIGINT)), '') AS lhs,
               coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank // CAST(pow(3, b.level) AS BIGINT)), '') AS rhs
        FROM {levels} a JOIN {levels} b
          ON a.level = 0 AND b.{key} IS NOT DISTINCT FROM a.{key} AND b.n > 1
         AND b.rank // 3 = a.rank // CAST(pow(3, b.level + 1) AS BIGINT)
        GROUP BY a.{key}, a.rank, b.level
    )"""


def merkle_sql() -> str:
    tampered = "replace(text, chr(10), '')"
    return f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {leaf('text')} AS leaf,
               CASE WHEN {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {leaf(tampered)} ELSE {leaf('text')} END AS shown
        FROM documents
    ), ranked AS (
        SELECT *, leaf AS digest, count(*) OVER (PARTITION BY source) AS n,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
        FROM leaves
    ), {merkle_levels("rows", "ranked", "source")}, tops AS (
        SELECT source, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, 0 AS tree
        FROM rows WHERE n = 1
    ), {merkle_levels("upper", "tops", "tree")}, {merkle_paths("row_paths", "rows", "source")},
    {merkle_paths("top_paths", "upper", "tree")}, steps AS (
        SELECT source, leaf_rank, level, lhs, rhs FROM row_paths
        UNION ALL
        SELECT t.source, r.rank, 1000 + p.level, p.lhs, p.rhs
        FROM ranked r JOIN tops t ON t.source IS NOT DISTINCT FROM r.source JOIN top_paths p ON p.leaf_rank = t.rank
    ), paths AS (
        SELECT source, leaf_rank, list(lhs ORDER BY level) AS lhs, list(rhs ORDER BY level) AS rhs,
               string_agg(lhs || rhs, '' ORDER BY level) AS siblings
        FROM steps GROUP BY source, leaf_rank
    ), folds AS (
        SELECT r.*, t.digest AS subroot, p.lhs, p.rhs, coalesce(p.siblings, '') AS siblings, 1 AS step, r.shown AS node
        FROM ranked r JOIN tops t ON t.source IS NOT DISTINCT FROM r.source
        LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM r.source AND p.leaf_rank = r.rank
        UNION ALL
        SELECT * REPLACE (step + 1 AS step, sha256(lhs[step] || node || rhs[step]) AS node) FROM folds WHERE step <= len(lhs)
    )
    SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified
    FROM folds, (SELECT digest AS root FROM upper WHERE n = 1)
    WHERE step > coalesce(len(lhs), 0)
    """


ORACLES = {
    "op5_perspective_rotation": perspective.ORACLE_SQL,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_cover_tree_search": """
        WITH usable AS (
            SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.id AS query_id, d.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM usable q JOIN usable d ON q.r <> d.r
            WHERE q.id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
    """,
    "op11_line_runs": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
        ), judged AS (
            SELECT k.*, p.key IS NOT NULL AND k.doc_id IS DISTINCT FROM p.keep AS gone
            FROM keyed k LEFT JOIN repeated p ON p.key = k.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id
    """,
    "op13_merkle_manifest": merkle_sql(),
}
