"""SQL for DuckDB that several oracles share."""

from __future__ import annotations

#: Words of a text: runs without white space.
WORDS = "CAST(len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')) AS BIGINT)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return WORDS.format(x)


def strip(x: str) -> str:
    return STRIP.format(x)


def pack(pieces: str, size: int, overlap: int, joiner: str) -> str:
    """CTEs up to ``chunks(k, st, en, raw, content)``: greedy packing of ``pieces``, a SELECT of (k, i, piece, n) with i from 0; lengths of joiners count nothing."""
    return f"""
    p AS ({pieces}),
    ps AS (SELECT k, i, piece, n, CAST(coalesce(sum(n) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM p),
    best AS (SELECT a.k, a.i, min(q.i) AS j FROM ps a JOIN ps q ON q.k = a.k AND q.i <= a.i WHERE a.b - q.b <= {overlap} AND (a.b = q.b OR a.b - q.b + a.n <= {size}) GROUP BY a.k, a.i),
    ps2 AS (SELECT ps.*, best.j, o.b AS jb FROM ps JOIN best ON best.k = ps.k AND best.i = ps.i JOIN ps o ON o.k = ps.k AND o.i = best.j),
    f AS (
      SELECT k, i, CASE WHEN n > {size} THEN i + 1 ELSE i END AS st, CASE WHEN n > {size} THEN n ELSE 0 END AS bst, CAST(NULL AS BIGINT) AS es, CASE WHEN n > {size} THEN i END AS raw FROM ps2 WHERE i = 0
      UNION ALL
      SELECT q.k, q.i,
        CASE WHEN q.b - f.bst + q.n <= {size} THEN f.st WHEN greatest(f.st, q.j) = q.i AND q.n > {size} THEN q.i + 1 ELSE greatest(f.st, q.j) END,
        CASE WHEN q.b - f.bst + q.n <= {size} THEN f.bst WHEN greatest(f.st, q.j) = q.i AND q.n > {size} THEN q.b + q.n WHEN q.j > f.st THEN q.jb ELSE f.bst END,
        CASE WHEN q.b - f.bst + q.n > {size} AND f.st < q.i THEN f.st END,
        CASE WHEN q.b - f.bst + q.n > {size} AND greatest(f.st, q.j) = q.i AND q.n > {size} THEN q.i END
      FROM f JOIN ps2 q ON q.k = f.k AND q.i = f.i + 1
    ),
    cut AS (
      SELECT k, es AS st, i AS en, false AS raw FROM f WHERE es IS NOT NULL
      UNION ALL SELECT k, raw, raw + 1, true FROM f WHERE raw IS NOT NULL
      UNION ALL SELECT k, st, i + 1, false FROM f WHERE st <= i AND i = (SELECT max(z.i) FROM p z WHERE z.k = f.k)
    ),
    joined AS (SELECT cut.k, st, en, raw, string_agg(p.piece, {joiner} ORDER BY p.i) AS t FROM cut JOIN p ON p.k = cut.k AND p.i >= st AND p.i < en GROUP BY cut.k, st, en, raw),
    chunks AS (SELECT k, st, en, raw, CASE WHEN raw THEN t ELSE {strip("t")} END AS content FROM joined WHERE raw OR {strip("t")} <> '')"""


LINES = "SELECT doc_id AS k, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS BIGINT) AS i, piece, {n} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents) WHERE piece <> ''"
