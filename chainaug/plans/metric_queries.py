"""Queries for generation metrics: M1-M7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as BS
from ..operators import metrics as MT
from ..operators import selection as S
from ..operators.numbering import with_group_position
from ..sources import fixtures as X
from .oracle_views import H, R6, with_ctes
from .registry import query
from .sequence_queries import ROUGE_TOK, WS

PAIRS = ("pairs", "SELECT run, idx, generation, label FROM scored_run "
                  "UNION ALL SELECT run, idx, generation, label FROM conversation_pairs")
FIX = ["scored_run", "conversation_pairs"]


def pairs_df(spark, d):
    return X.scored_run(spark, d).unionByName(X.conversation_pairs(spark, d))


def _fm(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) > 0 THEN 2.0::DOUBLE * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END)"


def _grams_sql(src: str, keys: str, tok: str, orders: list[int], name: str) -> list[tuple[str, str]]:
    """CTEs: ``{name}_t`` tokens, ``{name}_o`` clipped overlap per (keys, idx, n)."""
    ns = ", ".join(str(n) for n in orders)
    side = lambda col, s: (
        f"SELECT {keys}, idx, n, {s} AS s, array_to_string({col}[i:i + n - 1], ' ') AS gram FROM ("
        f"SELECT {keys}, idx, {col}, n, unnest(range(1, len({col}) - n + 2)) AS i FROM {name}_t "
        f"CROSS JOIN (SELECT unnest([{ns}]) AS n))")
    return [
        (f"{name}_t", f"SELECT {keys}, idx, {tok.format(c='generation')} AS pt, {tok.format(c='label')} AS rt FROM {src}"),
        (f"{name}_o", f"""SELECT {keys}, idx, n, sum(least(cp, cr)) AS o FROM (
            SELECT {keys}, idx, n, gram, sum((s = 0)::BIGINT) AS cp, sum((s = 1)::BIGINT) AS cr FROM (
              {side('pt', 0)} UNION ALL {side('rt', 1)}) GROUP BY ALL) GROUP BY ALL"""),
    ]


_WS_T = WS("{c}")
_RG_T = ROUGE_TOK("{c}")


def bleu_expr() -> str:
    """BLEU-4 from the sums c1-c4, m1-m4, pred_len and ref_len."""
    prec = [f"(CASE WHEN c{n} > 0 THEN m{n}::DOUBLE / c{n} ELSE 0.0 END)" for n in (1, 2, 3, 4)]
    allpos = " AND ".join(f"{p} > 0" for p in prec)
    logs = " + ".join(f"ln(CASE WHEN {p} > 0 THEN {p} END)" for p in prec)
    ratio = "(CASE WHEN ref_len > 0 THEN pred_len::DOUBLE / ref_len END)"
    bp = (f"(CASE WHEN {ratio} IS NULL OR {ratio} > 1 THEN 1.0 WHEN {ratio} > 0 "
          f"THEN exp(1.0::DOUBLE - 1.0::DOUBLE / {ratio}) ELSE 0.0 END)")
    geo = f"(CASE WHEN {allpos} THEN exp(({logs}) / 4) ELSE 0.0 END)"
    return f"CASE WHEN pred_len > 0 THEN {geo} * {bp} ELSE 0.0 END"


def bleu_sql(src: str, keys: str, name: str = "bl") -> list[tuple[str, str]]:
    cte = _grams_sql(src, keys, _WS_T, [1, 2, 3, 4], name)
    tot = ", ".join(f"sum(greatest(len(pt) - {n - 1}, 0)) AS c{n}" for n in (1, 2, 3, 4))
    ms = ", ".join(f"coalesce(sum(o) FILTER (WHERE n = {n}), 0) AS m{n}" for n in (1, 2, 3, 4))
    cte += [
        (f"{name}_tot", f"SELECT {keys}, sum(len(pt))::BIGINT AS pred_len, sum(len(rt))::BIGINT AS ref_len, {tot} FROM {name}_t GROUP BY ALL"),
        (f"{name}_m", f"SELECT {keys}, {ms} FROM {name}_o GROUP BY ALL"),
        (name, f"""SELECT {', '.join('t.' + k.strip() for k in keys.split(','))},
            {R6(bleu_expr())} AS bleu, pred_len, ref_len
            FROM {name}_tot t LEFT JOIN {name}_m m USING ({keys})"""),
    ]
    return cte


def rouge_n_sql(src: str, keys: str, name: str = "rn") -> list[tuple[str, str]]:
    cte = _grams_sql(src, keys, _RG_T, [1, 2], name)
    cols = []
    for n in (1, 2):
        o = f"coalesce(o{n}, 0)::DOUBLE"
        cols.append(f"{R6(_fm(f'{o} / greatest(len(pt) - {n - 1}, 1)', f'{o} / greatest(len(rt) - {n - 1}, 1)'))} AS rouge{n}")
    cte.append((name, f"""SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, t.idx, {', '.join(cols)} FROM {name}_t t LEFT JOIN (
        SELECT {keys}, idx, max(o) FILTER (WHERE n = 1) AS o1, max(o) FILTER (WHERE n = 2) AS o2 FROM {name}_o GROUP BY ALL) x
        USING ({keys}, idx)"""))
    return cte


def rouge_l_sql(src: str, keys: str, name: str = "rl") -> list[tuple[str, str]]:
    """LCS by a recursive CTE: one step per prediction token, the DP row as (j, v) rows and the
    running max as a window (O(n*m) cells per pair, whole texts)."""
    part = ", ".join(f"d.{k.strip()}" for k in keys.split(",")) + ", d.idx"
    on = " AND ".join(f"d.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return [
        (f"{name}_t", f"SELECT {keys}, idx, {_RG_T.format(c='generation')} AS a, {_RG_T.format(c='label')} AS b FROM {src}"),
        (f"{name}_dp", f"""
          SELECT {keys}, idx, 0 AS i, unnest(range(0, len(b) + 1)) AS j, 0 AS v FROM {name}_t
          UNION ALL
          SELECT {keys}, idx, i1, j, max(c) OVER (PARTITION BY {keys}, idx ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
            SELECT {part}, d.i + 1 AS i1, d.j,
                   greatest(d.v, CASE WHEN d.j > 0 AND p.a[d.i + 1] = p.b[d.j]
                                      THEN lag(d.v) OVER (PARTITION BY {part} ORDER BY d.j) + 1 ELSE 0 END) AS c
            FROM {name}_dp d JOIN {name}_t p ON {on} AND d.idx = p.idx WHERE d.i < len(p.a))"""),
        (name, f"""SELECT {keys}, idx, lcs,
            {R6(_fm("CASE WHEN la > 0 THEN lcs::DOUBLE / la ELSE 0.0 END",
                    "CASE WHEN lb > 0 THEN lcs::DOUBLE / lb ELSE 0.0 END"))} AS rougeL
            FROM (SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.idx, len(p.a) AS la, len(p.b) AS lb,
                         max(d.v)::BIGINT AS lcs
                  FROM {name}_t p JOIN {name}_dp d ON {on} AND d.idx = p.idx AND d.i = len(p.a) GROUP BY ALL)"""),
    ]


def M6(x: str) -> str:
    return R6(f"sum(floor(({x}) * 1e6 + 0.5))::DOUBLE / (count({x}) * 1e6)")


def rouge_corpus_sql(keys: str) -> list[tuple[str, str]]:
    return [("rc", f"""SELECT {', '.join('n.' + k.strip() for k in keys.split(','))}, count(*) AS n_pairs,
        {M6('n.rouge1')} AS rouge1, {M6('n.rouge2')} AS rouge2, {M6('l.rougeL')} AS rougeL
        FROM rn n JOIN rl l USING ({keys}, idx) GROUP BY ALL""")]


def emb_sql(src: str, keys: str) -> list[tuple[str, str]]:
    tok = "list_filter(string_split({c}, ' '), lambda x: x <> '')"
    side = lambda c: (
        f"SELECT {keys}, idx, unnest({tok.format(c=c)}) AS token, unnest(range(1, len({tok.format(c=c)}) + 1)) AS p FROM {src}")
    kk = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return [
        ("tv", "SELECT token, e, sqrt(list_dot_product(e, e)) AS nrm FROM (SELECT token, embedding::DOUBLE[] AS e FROM token_vectors)"),
        ("et_p", side("generation")), ("et_r", side("label")),
        ("sim", f"""SELECT {kk('a')}, a.idx, a.p AS pa, b.p AS pb, list_dot_product(va.e, vb.e) / (va.nrm * vb.nrm) AS s
            FROM et_p a JOIN tv va ON a.token = va.token JOIN et_r b ON {on} AND a.idx = b.idx JOIN tv vb ON b.token = vb.token"""),
        ("ep", f"SELECT {keys}, idx, {M6('m')} AS p FROM (SELECT {keys}, idx, pa, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL"),
        ("er", f"SELECT {keys}, idx, {M6('m')} AS r FROM (SELECT {keys}, idx, pb, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL"),
        ("emb", f"""SELECT {kk('s')}, s.idx, coalesce(ep.p, 0.0) AS p, coalesce(er.r, 0.0) AS r,
            coalesce({R6(_fm('ep.p', 'er.r'))}, 0.0) AS f1
            FROM {src} s LEFT JOIN ep USING ({keys}, idx) LEFT JOIN er USING ({keys}, idx)"""),
    ]


@query("corpus_bleu", with_ctes(FIX, [PAIRS] + bleu_sql("pairs", "run"), "SELECT * FROM bl"))
def corpus_bleu(spark, d):
    return MT.corpus_bleu(pairs_df(spark, d), ["run"])


@query("rouge_n", with_ctes(FIX, [PAIRS] + rouge_n_sql("pairs", "run"), "SELECT * FROM rn"))
def rouge_n(spark, d):
    return MT.rouge_n(pairs_df(spark, d), ["run"])


@query("rouge_l", with_ctes(FIX, [PAIRS] + rouge_l_sql("pairs", "run"), "SELECT * FROM rl", recursive=True))
def rouge_l(spark, d):
    return MT.rouge_l(pairs_df(spark, d), ["run"])


@query("rouge_corpus", with_ctes(FIX, [PAIRS] + rouge_n_sql("pairs", "run") + rouge_l_sql("pairs", "run")
                                 + rouge_corpus_sql("run"), "SELECT * FROM rc", recursive=True))
def rouge_corpus(spark, d):
    return MT.rouge_corpus(MT.rouge_scores(pairs_df(spark, d), ["run"]), ["run"])


_B = 100


def _poisson_sql(h: str) -> str:
    bounds = BS.poisson_bounds()
    return "(CASE " + " ".join(f"WHEN {h} < {b} THEN {k}" for k, b in enumerate(bounds)) + f" ELSE {len(bounds)} END)"


_DRAW = f"(('0x' || substr(md5('42:' || ((b - 1) // {BS.WORDS}) || ':' || run || ':' || idx), 1 + 8 * ((b - 1) % {BS.WORDS}), 8))::BIGINT)"
_INTERVAL = ", ".join(f"{R6(f'quantile_cont(m, {q})')} AS q{int(q * 1000):03d}" for q in (0.025, 0.5, 0.975))
_COUNTS = [f"{x}{n}" for x in "mc" for n in (1, 2, 3, 4)] + ["pred_len", "ref_len"]


@query("rouge_bootstrap", with_ctes(FIX, [PAIRS] + rouge_n_sql("pairs", "run") + rouge_l_sql("pairs", "run") + bleu_sql("pairs", "run") + [
    ("bw", f"""SELECT run, idx, b, {_poisson_sql(_DRAW)} AS w
        FROM pairs CROSS JOIN (SELECT unnest(range(1, {_B + 1})) AS b)"""),
    ("rouge", """SELECT n.run, n.idx, unnest(['rouge1', 'rouge2', 'rougeL']) AS metric, unnest([n.rouge1, n.rouge2, l.rougeL]) AS v
        FROM rn n JOIN rl l USING (run, idx)"""),
    ("rouge_m", """SELECT run, metric, b, CASE WHEN sum(w) > 0 THEN sum(w * floor(v * 1e6 + 0.5))::DOUBLE / (sum(w) * 1e6) END AS m
        FROM rouge JOIN bw USING (run, idx) GROUP BY ALL"""),
    ("counts", f"""SELECT t.run, t.idx, {", ".join(f"coalesce(m{n}, 0) AS m{n}, greatest(len(pt) - {n - 1}, 0) AS c{n}" for n in (1, 2, 3, 4))},
        len(pt) AS pred_len, len(rt) AS ref_len FROM bl_t t LEFT JOIN (
          SELECT run, idx, {", ".join(f"max(o) FILTER (WHERE n = {n}) AS m{n}" for n in (1, 2, 3, 4))} FROM bl_o GROUP BY ALL) USING (run, idx)"""),
    ("bleu_b", f"""SELECT run, b, {", ".join(f"sum(w * {c}) AS {c}" for c in _COUNTS)} FROM counts JOIN bw USING (run, idx) GROUP BY ALL"""),
    ("every", f"SELECT run, metric, m FROM rouge_m UNION ALL SELECT run, 'bleu', {bleu_expr()} FROM bleu_b")],
    f"SELECT run, metric, {_INTERVAL} FROM every GROUP BY run, metric", recursive=True))
def rouge_bootstrap(spark, d):
    """M4: intervals of ROUGE-1, -2, -L and BLEU."""
    return MT.bootstrap(pairs_df(spark, d), ["run"], replicates=_B, seed=42)


@query("embedding_f1", with_ctes(FIX + ["token_vectors"], [PAIRS] + emb_sql("pairs", "run"), "SELECT * FROM emb"))
def embedding_f1(spark, d):
    return MT.embedding_f1(pairs_df(spark, d), ["run"], X.token_vectors(spark, d))


@query("embedding_f1_corpus", with_ctes(FIX + ["token_vectors"], [PAIRS] + emb_sql("pairs", "run"),
       f"SELECT run, count(*) AS n_pairs, {M6('p')} AS p, {M6('r')} AS r, {M6('f1')} AS f1 FROM emb GROUP BY run"))
def embedding_f1_corpus(spark, d):
    return MT.embedding_f1_corpus(MT.embedding_f1(pairs_df(spark, d), ["run"], X.token_vectors(spark, d)), ["run"])


@query("score_grid", with_ctes(FIX + ["token_vectors"], [PAIRS] + emb_sql("pairs", "run") + bleu_sql("pairs", "run")
                               + rouge_n_sql("pairs", "run") + rouge_l_sql("pairs", "run") + rouge_corpus_sql("run"), f"""
SELECT e.run AS model_name, {M6('e.f1')} AS bert_score, rc.rouge1 AS rouge_1, rc.rouge2 AS rouge_2, rc.rougeL AS rouge_l, bl.bleu
FROM emb e JOIN rc USING (run) JOIN bl USING (run) GROUP BY e.run, rc.rouge1, rc.rouge2, rc.rougeL, bl.bleu""", recursive=True))
def score_grid(spark, d):
    return MT.score_grid(pairs_df(spark, d), X.token_vectors(spark, d), "run")


_EV_KEYS = "target, fold, round"


@query("epoch_validation", with_ctes(["generation"], [("gp", "SELECT target, fold, round, idx, generation, label, f1 FROM generation")]
                                     + bleu_sql("gp", _EV_KEYS) + rouge_n_sql("gp", _EV_KEYS) + rouge_l_sql("gp", _EV_KEYS)
                                     + rouge_corpus_sql(_EV_KEYS) + [
    ("pb", f"""SELECT {_EV_KEYS}, pos // 16 AS b, sum(floor((1.0::DOUBLE - f1) * 1e6 + 0.5))::BIGINT AS s, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY {_EV_KEYS} ORDER BY idx) - 1 AS pos FROM gp) GROUP BY ALL"""),
    ("vl", f"""SELECT {_EV_KEYS}, {R6("sum((2 * s + n) // (2 * n))::DOUBLE / (count(*) * 1e6)")} AS val_loss
        FROM pb GROUP BY ALL""")], f"""
SELECT target, fold, round, bl.bleu, rc.rouge1, rc.rouge2, rc.rougeL, vl.val_loss
FROM bl JOIN rc USING ({_EV_KEYS}) JOIN vl USING ({_EV_KEYS})""", recursive=True))
def epoch_validation(spark, d):
    """M7: per (target, fold, round) validation scores of the generation table plus the mean
    batch loss (loss = 1 - f1, batches of 16 consecutive rows by idx)."""
    keys = ["target", "fold", "round"]
    g = X.generation(spark, d)
    bl = MT.corpus_bleu(g, keys).select(*keys, "bleu")
    rc = MT.rouge_corpus(MT.rouge_scores(g, keys), keys).drop("n_pairs")
    pos = with_group_position(g.select(*keys, "idx", "f1"), keys, ["idx"])
    loss = pos.withColumn("batch", F.floor(F.col("pos") / 16)).withColumn("loss", F.lit(1.0) - F.col("f1"))
    vl = S.batch_mean_loss(loss, keys, "batch", "loss").select(*keys, F.col("mean_batch_loss").alias("val_loss"))
    return bl.join(rc, keys).join(vl, keys).select(*keys, "bleu", "rouge1", "rouge2", "rougeL", "val_loss")
