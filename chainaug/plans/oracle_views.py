"""DuckDB forms of the fixture views, as CTE text for the oracle SQL.

The driver registers the raw tables as views; each oracle query starts with
``WITH <the fixture CTEs it needs>``.  ``H(e)`` is the portable hash, ``R6(e)`` the portable
6-digit rounding (see chainaug.functions.columns).
"""

from __future__ import annotations


def H(e: str) -> str:
    return f"(('0x' || substr(md5(({e})::VARCHAR), 1, 8))::BIGINT)"


def R6(e: str) -> str:
    return f"(floor(({e}) * 1e6 + 0.5) / 1e6)"


CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


_cte("docs_p", [], r"""
SELECT d.doc_id, regexp_split_to_array(d.text, '[.][ \t\n\r\f]+') AS p, l.quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

_cte("corpus", ["docs_p"], r"""
SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS idx, premise_1, premise_2,
       CASE WHEN quality = 1 AND conclusion IS NOT NULL THEN 'yes' ELSE 'no' END AS relation, conclusion
FROM (
  SELECT doc_id, quality, k, p[3 * k + 1] AS premise_1, p[3 * k + 2] AS premise_2,
         array_to_string(p[3 * k + 3 : CASE WHEN k = len(p) // 3 - 1 THEN len(p) ELSE 3 * k + 3 END], '. ') AS conclusion
  FROM (SELECT *, unnest(range(0, len(p) // 3)) AS k FROM docs_p WHERE len(p) >= 3)
  UNION ALL
  SELECT doc_id, quality, 0 AS k, NULL, NULL, NULL FROM docs_p WHERE p IS NULL OR len(p) < 3)""")

_cte("valid", ["corpus"], "SELECT * FROM corpus WHERE relation = 'yes'")

_cte("folds", ["valid"], f"""
SELECT idx, (ntile(5) OVER (ORDER BY {H("'42:' || idx")}, idx) - 1)::INTEGER AS fold FROM valid""")

_cte("gen_base", ["valid", "folds"], """
SELECT v.idx, f.fold, r.round, t.target,
       CASE t.target WHEN 'prem1' THEN v.premise_1 ELSE v.premise_2 END AS label
FROM valid v JOIN folds f ON v.idx = f.idx
CROSS JOIN (SELECT unnest([1, 2, 3]) AS round) r
CROSS JOIN (SELECT unnest(['prem1', 'prem2']) AS target) t""")

_cte("generation", ["gen_base"], f"""
SELECT idx, round, target, fold, array_to_string(kt, ' ') AS generation, label,
       {R6("(2 * len(kt))::DOUBLE / (len(kt) + len(toks))")} AS f1
FROM (SELECT *, CASE WHEN len(kt0) = 0 THEN toks ELSE kt0 END AS kt
      FROM (SELECT *, list_filter(list_transform(range(1, len(toks) + 1),
                    lambda i: CASE WHEN {H("round || ':' || target || ':' || idx || ':' || i")} % 10 = 0
                                   THEN NULL ELSE toks[i] END), lambda x: x IS NOT NULL) AS kt0
            FROM (SELECT *, string_split(label, ' ') AS toks FROM gen_base)))""")

_cte("epoch_log", [], f"""
SELECT event_type AS run, (user_id % 5)::INTEGER AS fold,
       datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS seq,
       (datediff('day', DATE '2024-01-01', ts::DATE) - 1)::INTEGER AS epoch,
       {R6("sum(round(value * 100)::BIGINT) / (count(*) * 10000)::DOUBLE")} AS val_bleu,
       {R6("max(value) / 100.0")} AS val_rouge1,
       {R6("min(value) / 100.0")} AS val_rouge2,
       {R6("sum(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)) / (count(*) * 100)::DOUBLE")} AS val_rougeL,
       {R6("sum(round(value * 100)::BIGINT) / (count(*) * 100)::DOUBLE")} AS val_loss,
       count(*) AS data_length
FROM events GROUP BY ALL""")

_cte("token_vectors", ["valid"], f"""
SELECT t.token, e.embedding
FROM (SELECT DISTINCT unnest(string_split(concat_ws(' ', premise_1, premise_2, conclusion), ' ')) AS token FROM valid) t
JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding, count(*) OVER () AS n FROM embeddings) e
  ON {H("t.token")} % e.n = e.place""")

_cte("scored_run", ["valid"], f"""
SELECT run, idx,
       array_to_string(list_filter(list_transform(range(1, len(toks) + 1),
           lambda i: CASE WHEN {H("run || ':' || idx || ':' || i")} % m = 0 THEN NULL ELSE toks[i] END),
           lambda x: x IS NOT NULL), ' ') AS generation,
       label
FROM (SELECT idx, m, 'run' || m AS run, conclusion AS label, string_split(conclusion, ' ') AS toks
      FROM valid CROSS JOIN (SELECT unnest([5, 10, 20]) AS m))""")

_cte("conversation_pairs", [], """
SELECT 'conversations' AS run, row_number() OVER (ORDER BY u.conv_id, u.turn, u.text, a.text) - 1 AS idx, a.text AS generation, u.text AS label
FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""")


def with_ctes(names: list[str], extra: list[tuple[str, str]], select: str, recursive: bool = False) -> str:
    """``WITH`` clause holding ``names`` (and their dependencies, in order) followed by the
    query-specific CTEs ``extra`` and the final ``select``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({body})" for n, body in extra]
    head = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n") if parts else ""
    return head + select
