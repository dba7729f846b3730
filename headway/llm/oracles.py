"""SQL counterparts in DuckDB's dialect of the operators that SQL can express."""

from __future__ import annotations

import string

from headway.llm import secrets, sharding

WORDS = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ngram_jaccard(n: int = 4, percent: int = 85) -> str:
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, {_quoted(WORDS)}) AS ws FROM documents),
      g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + {n - 1}], ' ') AS g FROM (
        SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) AS k FROM w WHERE len(ws) > 0)),
      s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
      c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * i >= {percent} * (p.n + q.n - i)),
      r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.low AS component_id FROM documents d LEFT JOIN s USING (doc_id)
      JOIN (SELECT node, min(low) AS low FROM r GROUP BY 1) m ON m.node = d.doc_id"""


def substrings(size: int = 20) -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_quoted(WORDS)}) AS ws FROM documents),
      g AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + {size - 1}], ' ')) AS h FROM (
        SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS k FROM w WHERE len(ws) >= {size})),
      r AS (SELECT doc_id, k FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1),
      gone AS (SELECT DISTINCT doc_id, k + j AS p FROM r, range({size}) t(j)),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (
        SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
      FROM w LEFT JOIN kept USING (doc_id)"""


def secret_spans() -> str:
    """The matches before a match and the pieces between them add up to its start."""
    rules = (*secrets.BASE, *secrets.MORE)
    parts = []
    for i, r in enumerate(rules):
        # a run of hexadecimal digits is a match whole or not at all, so its length can stand in the pattern
        pattern = _quoted(r.pattern if r.kind != "hex" else r.pattern.replace("+", "{%d,}" % r.least))
        parts.append(
            f"SELECT doc_id, {i} AS ord, {_quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {pattern}, 0) AS a, "
            f"regexp_extract_all(t, {pattern}, {r.group}) AS b, regexp_split_to_array(t, {pattern}) AS gaps FROM d"
        )
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    line = "string_agg(kind || ':' || st || ':' || (st + size), ',' ORDER BY st, ord)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
      u AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m WHERE len(a) > 0),
      s AS (SELECT doc_id, ord, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st, length(a[i]) AS size
        FROM u WHERE length(b[i]) >= least),
      f AS (SELECT doc_id, {counts}, {line} FILTER (ord < {len(secrets.BASE)}) AS base, {line} AS spans FROM s GROUP BY 1)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


def collocations(least: int = 100, top: int = 2000) -> str:
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
      t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
      g AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, ws[k:k + m - 1] AS g FROM (
        SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, range(1, 6) s(m))) GROUP BY ALL HAVING count(*) >= {least}),
      c AS (SELECT lang, m, g, f, unnest(range(1, m)) AS k FROM g WHERE m >= 2),
      s AS (SELECT c.lang, c.m, c.g, c.f AS a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
        FROM c JOIN t USING (lang) JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
      d AS (SELECT lang, g[1:m - 1] AS g, f FROM g WHERE m > 2 UNION SELECT lang, g[2:], f FROM g WHERE m > 2),
      k AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b ANTI JOIN d ON d.lang = b.lang AND d.g = b.g AND d.f >= b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
      CAST(score AS BIGINT) AS score FROM k QUALIFY rank <= {top}"""


def centroids(dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """Every round compares all vectors with all centroids; ``//`` of whole numbers that divide evenly gives the floor."""
    square = "list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"SELECT x.i, any_value(x.v) AS v, min({{'d': CAST({square} AS BIGINT), 'c': y.c}}) AS b FROM k x, %s y GROUP BY x.i"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({near % f"c{i}"}),
      c{i + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS w FROM (
        SELECT b.c AS c, p, count(*) AS n, sum(e)::BIGINT AS s FROM (SELECT b, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY ALL) GROUP BY 1) USING (c))""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM k QUALIFY c < {k}),
      {', '.join(steps)}, f AS ({near % f"c{rounds}"})
    SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y.v, ',')) AS centroid_sha256
    FROM f JOIN k USING (i) JOIN c{rounds} y ON y.c = f.b.c"""


def all_sql(shard_bytes: int) -> dict[str, str]:
    return {
        "op2_ngram_jaccard": ngram_jaccard(), "op5_sharding": sharding.oracle(shard_bytes), "op6_secrets": secret_spans(), "op8_substrings": substrings(),
        "op11_collocations": collocations(), "op12_centroids": centroids(),
    }
