"""DuckDB SQL of the operators that SQL can express."""

SQL: dict[str, str] = {}

SQL["op6_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS n,
         ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE)
           / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, w * (SELECT arg_min(level, n) FROM r WHERE 3 * source_size >= level * w)), 3.0::DOUBLE * source_size) AS target
  FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT x.source, x.h, sum(x.tokens) OVER (PARTITION BY x.source ORDER BY x.h) AS upto, x.tokens, g.target - g.epochs * g.source_size AS rest
  FROM (SELECT source, h, sum(size) AS tokens FROM d GROUP BY source, h) x JOIN g ON x.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
       CAST(g.epochs + CASE WHEN c.upto <= c.rest OR (c.upto - c.tokens <= c.rest AND 2 * (c.rest - (c.upto - c.tokens)) >= c.tokens) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(d.size * (g.epochs + CASE WHEN c.upto <= c.rest OR (c.upto - c.tokens <= c.rest AND 2 * (c.rest - (c.upto - c.tokens)) >= c.tokens) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

SQL["op7_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns, count(*) AS n_turns,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM u))
SELECT conv_id, n_turns, n_copies, CAST(0 AS INT) AS part, CAST(1 AS INT) AS n_parts, rendered
FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""


def _vector_codes() -> str:
    """The rounds one after another, each assigning all parts to all entries."""
    gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT"
    steps = [
        """WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j, x[j * (len(x) // 8) + 1 : (j + 1) * (len(x) // 8)] AS x FROM v, range(8) r(j)),
b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))"""
    ]
    for k in range(7):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.label, p.j, p.x, min({{'d': {gap}, 'e': b.e}}) AS best FROM p JOIN b{k} b ON p.j = b.j GROUP BY ALL)")
        if k < 6:
            steps.append(f"""u{k} AS (SELECT j, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, best.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{k} GROUP BY j, e),
b{k + 1} AS MATERIALIZED (SELECT b{k}.j, b{k}.e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} ON b{k}.j = m{k}.j AND b{k}.e = m{k}.e)""")
    return (
        ",\n".join(steps)
        + """,
c AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY j) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) FROM b6) AS codebooks_sha256
FROM c"""
    )


SQL["op12_vector_codes"] = _vector_codes()
