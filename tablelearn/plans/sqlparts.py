"""SQL fragments (DuckDB dialect) shared by the oracle queries."""

from __future__ import annotations

EMB = """(SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x
          FROM embeddings, range(1, 65) r(i))"""

LEARN = """(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1,
   CASE WHEN CAST(embedding[1] AS DOUBLE) + 0.5 * CAST(embedding[2] AS DOUBLE)
             + 0.05 * (CAST(('0x' || substr(md5(concat('n:', CAST(vec_id AS VARCHAR))), 1, 6))
                            AS BIGINT) / 16777216.0 - 0.5) > 0 THEN 1 ELSE 0 END AS y
   FROM embeddings)"""

LEARN_LONG = """(SELECT vec_id, y, 0 AS pos, x0 AS x FROM learn
                 UNION ALL SELECT vec_id, y, 1, x1 FROM learn)"""

EVENT = """(SELECT event_id, value, CAST(hour(ts) AS DOUBLE) AS hour,
   CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
   CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS purchase FROM events)"""


def stratified_split(src: str, id: str, label: str, test_size: float = 0.2,
                     seed: int = 42) -> str:
    """CTE body: (id, label, split) -- same quota and hash rules as the engine."""
    return f"""
(WITH s AS (SELECT {id} AS id, {label} AS lab FROM {src}),
 cnt AS (SELECT lab, count(*) AS nc FROM s GROUP BY lab),
 tot AS (SELECT sum(nc) AS n, CAST(ceil({test_size}::DOUBLE * sum(nc)) AS BIGINT) AS nt FROM cnt),
 q1 AS (SELECT lab, nc, (nc * (n - nt)) // n AS fl, (nc * (n - nt)) % n AS rem, n, nt
        FROM cnt, tot),
 q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, lab) AS o,
               (n - nt) - sum(fl) OVER () AS need FROM q1),
 q AS (SELECT lab, nc - (fl + CASE WHEN o <= need AND rem > 0 THEN 1 ELSE 0 END) AS ntest
       FROM q2),
 r AS (SELECT id, lab, row_number() OVER (PARTITION BY lab
           ORDER BY md5(concat('{seed}:', CAST(id AS VARCHAR))), id) - 1 AS j FROM s)
 SELECT r.id AS {id}, r.lab AS {label},
        CASE WHEN j < ntest THEN 'test' ELSE 'train' END AS split
 FROM r JOIN q USING (lab))"""


def gaussian_nb(train_long: str, test_long: str, label: str, id: str) -> str:
    """CTE body: (id, c, jll) for every test row and class.

    train_long/test_long: (id, label, pos, x)."""
    return f"""
(WITH st AS (SELECT {label} AS c, pos, avg(x) AS m, var_pop(x) AS v FROM {train_long}
             GROUP BY {label}, pos),
 eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT pos, var_pop(x) AS v FROM {train_long}
                                          GROUP BY pos)),
 pr AS (SELECT c, ln(CAST(nc AS DOUBLE) / sum(nc) OVER ()) AS lp
        FROM (SELECT {label} AS c, count(DISTINCT {id}) AS nc FROM {train_long} GROUP BY 1)),
 ll AS (SELECT t.{id} AS id, st.c, sum(-0.5 * ln(2 * pi() * (st.v + e))
                 - 0.5 * (t.x - st.m) * (t.x - st.m) / (st.v + e)) AS s
        FROM {test_long} t JOIN st ON t.pos = st.pos, eps GROUP BY t.{id}, st.c)
 SELECT id, ll.c, lp + s AS jll FROM ll JOIN pr ON ll.c = pr.c)"""


def argmax_proba(jll: str, classes: list) -> str:
    """(id, prediction, p_<c>...) from (id, c, jll)."""
    probs = ", ".join(
        f"sum(CASE WHEN c = {c} THEN exp(jll - mx) END) / sum(exp(jll - mx)) AS p_{c}"
        for c in classes)
    return f"""
(WITH j AS (SELECT id, c, jll, max(jll) OVER (PARTITION BY id) AS mx,
                   row_number() OVER (PARTITION BY id ORDER BY jll DESC, c) AS rk FROM {jll})
 SELECT id, CAST(max(CASE WHEN rk = 1 THEN c END) AS INTEGER) AS prediction, {probs}
 FROM j GROUP BY id)"""
