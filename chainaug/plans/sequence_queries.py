"""Queries for prompts and sequences: T1-T10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import sequences as SQ
from ..sources import fixtures as X
from .oracle_views import with_ctes
from .registry import query

MAX_LEN = 256
TARGETS = ("conclusion", "prem1", "prem2")


def WS(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


def ROUGE_TOK(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


_TGT = """SELECT v.idx, t.target,
  CASE WHEN t.target = 'prem1' THEN premise_2 ELSE premise_1 END AS a,
  CASE WHEN t.target = 'conclusion' THEN premise_2 ELSE conclusion END AS b,
  CASE t.target WHEN 'prem1' THEN premise_1 WHEN 'prem2' THEN premise_2 ELSE conclusion END AS y
FROM valid v CROSS JOIN (SELECT unnest(['conclusion', 'prem1', 'prem2']) AS target) t"""


def targets_df(spark, d):
    v = X.valid(spark, d)
    t = v.select("*", F.explode(F.array(*[F.lit(x) for x in TARGETS])).alias("target"))
    a, b, y = TX.target_case(F.col("target"), F.col("premise_1"), F.col("premise_2"), F.col("conclusion"))
    return t.select("idx", "target", a.alias("a"), b.alias("b"), y.alias("y"))


@query("prompt_bart", with_ctes(["valid"], [("tg", _TGT)], """
SELECT idx, target, '<s>' || a || '</s>' || ' ' || b || '</s>' || '<mask>' AS enc, '</s>' || '<s>' || y || '</s>' AS dec
FROM tg"""))
def prompt_bart(spark, d):
    t = targets_df(spark, d)
    enc, dec = TX.prompt_encdec(F.col("a"), F.col("b"), F.col("y"))
    return t.select("idx", "target", enc.alias("enc"), dec.alias("dec"))


@query("prompt_t5", with_ctes(["valid"], [("tg", _TGT)], """
SELECT idx, target, 'Syllogistic: ' || a || ' <sep> ' || b AS input, y AS label FROM tg"""))
def prompt_t5(spark, d):
    t = targets_df(spark, d)
    inp, lab = TX.prompt_prefix(F.col("a"), F.col("b"), F.col("y"))
    return t.select("idx", "target", inp.alias("input"), lab.alias("label"))


@query("prompt_gpt2", with_ctes(["valid"], [("tg", _TGT)], """
SELECT idx, target, '<|endoftext|> ' || a || '<|and|> ' || b || ' <|so|>' || y || '<|endoftext|>' AS full_text,
       '<|endoftext|> ' || a || '<|and|> ' || b || ' <|so|>' AS gen_input, y AS target_text FROM tg"""))
def prompt_gpt2(spark, d):
    t = targets_df(spark, d)
    full, gen, y = TX.prompt_causal(F.col("a"), F.col("b"), F.col("y"))
    return t.select("idx", "target", full.alias("full_text"), gen.alias("gen_input"), y.alias("target_text"))


@query("tokenize_ws", with_ctes(["valid"], [], f"""
SELECT idx, len({WS('conclusion')}) AS n_tokens, array_to_string({WS('conclusion')}, ' ') AS tokens FROM valid"""))
def tokenize_ws(spark, d):
    t = TX.ws_tokens(F.col("conclusion"))
    return X.valid(spark, d).select("idx", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("tokenize_rouge", with_ctes(["valid"], [], f"""
SELECT idx, len({ROUGE_TOK('conclusion')}) AS n_tokens, array_to_string({ROUGE_TOK('conclusion')}, ' ') AS tokens FROM valid"""))
def tokenize_rouge(spark, d):
    t = TX.rouge_tokens(F.col("conclusion"))
    return X.valid(spark, d).select("idx", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


_VOCAB = ("vocab", f"""
SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 + {len(SQ.SPECIALS)} AS id FROM (
  SELECT token, count(*) AS cnt FROM (
    SELECT unnest({WS('premise_1')} || {WS('premise_2')} || {WS('conclusion')}) AS token FROM valid)
  WHERE token NOT IN ({", ".join(f"'{s}'" for s in SQ.SPECIALS)}) GROUP BY token)""")

_ENC = ("enc", f"""
SELECT v.idx, coalesce(e.p1, []) AS p1, coalesce(e.p2, []) AS p2, coalesce(e.c, []) AS c FROM valid v LEFT JOIN (
  SELECT idx, list(id ORDER BY p) FILTER (WHERE col = 1) AS p1, list(id ORDER BY p) FILTER (WHERE col = 2) AS p2,
         list(id ORDER BY p) FILTER (WHERE col = 3) AS c
  FROM (SELECT x.idx, x.col, x.p, coalesce(vo.id, {SQ.UNK}) AS id FROM (
          SELECT idx, 1 AS col, unnest({WS('premise_1')}) AS token, unnest(range(1, len({WS('premise_1')}) + 1)) AS p FROM valid
          UNION ALL SELECT idx, 2, unnest({WS('premise_2')}), unnest(range(1, len({WS('premise_2')}) + 1)) FROM valid
          UNION ALL SELECT idx, 3, unnest({WS('conclusion')}), unnest(range(1, len({WS('conclusion')}) + 1)) FROM valid) x
        LEFT JOIN vocab vo ON x.token = vo.token)
  GROUP BY idx) e ON v.idx = e.idx""")


def encoded(spark, d):
    v = X.valid(spark, d)
    vocab = SQ.build_vocab(v, ["premise_1", "premise_2", "conclusion"])
    return SQ.encode_columns(v, "idx", {"premise_1": "p1", "premise_2": "p2", "conclusion": "c"}, vocab, keep=["idx"]), vocab


def _pad_sql(x: str, pad: int) -> str:
    return f"(({x})[1:{MAX_LEN}] || list_transform(range(greatest({MAX_LEN} - len({x}), 0)), lambda z: {pad}))"


def _mask_sql(x: str) -> str:
    n = f"least(len({x}), {MAX_LEN})"
    return f"(list_transform(range({n}), lambda z: 1) || list_transform(range({MAX_LEN} - {n}), lambda z: 0))"


@query("build_vocab", with_ctes(["valid"], [_VOCAB], "SELECT token, cnt, id FROM vocab"))
def build_vocab(spark, d):
    v = X.valid(spark, d)
    return SQ.build_vocab(v, ["premise_1", "premise_2", "conclusion"])


@query("encode_ids", with_ctes(["valid"], [_VOCAB, _ENC], "SELECT idx, len(c) AS n_ids, array_to_string(c, ',') AS ids FROM enc"))
def encode_ids(spark, d):
    e, _ = encoded(spark, d)
    return e.select("idx", F.size("c").cast("long").alias("n_ids"), SQ.ids_text(F.col("c")).alias("ids"))


_ENC_IDS = f"[{SQ.BOS}] || p1 || [{SQ.EOS}] || p2 || [{SQ.EOS}, {SQ.MASK}]"


@query("pad_and_mask", with_ctes(["valid"], [_VOCAB, _ENC], f"""
SELECT idx, len({_ENC_IDS}) AS n_ids, len({_ENC_IDS}) > {MAX_LEN} AS truncated,
       array_to_string({_pad_sql(_ENC_IDS, SQ.PAD)}, ',') AS ids, array_to_string({_mask_sql(_ENC_IDS)}, ',') AS mask
FROM enc"""))
def pad_and_mask(spark, d):
    e, _ = encoded(spark, d)
    enc = F.concat(F.array(F.lit(SQ.BOS)), "p1", F.array(F.lit(SQ.EOS)), "p2", F.array(F.lit(SQ.EOS), F.lit(SQ.MASK)))
    return e.select(
        "idx", F.size(enc).cast("long").alias("n_ids"), (F.size(enc) > MAX_LEN).alias("truncated"),
        SQ.ids_text(SQ.pad_right(enc, MAX_LEN, SQ.PAD)).alias("ids"),
        SQ.ids_text(SQ.attention_mask(enc, MAX_LEN)).alias("mask"),
    )


_DEC = f"[{SQ.EOS}, {SQ.BOS}] || c || [{SQ.EOS}]"


@query("decoder_shift", with_ctes(["valid"], [_VOCAB, _ENC], f"""
SELECT idx, array_to_string({_pad_sql(f"({_DEC})[1:len({_DEC}) - 1]", SQ.PAD)}, ',') AS dec_in,
       array_to_string({_pad_sql(f"({_DEC})[2:len({_DEC})]", SQ.IGNORE)}, ',') AS dec_target,
       array_to_string({_mask_sql(f"({_DEC})[1:len({_DEC}) - 1]")}, ',') AS dec_mask, len({_DEC}) - 1 > {MAX_LEN} AS truncated
FROM enc"""))
def decoder_shift(spark, d):
    e, _ = encoded(spark, d)
    dec = F.concat(F.array(F.lit(SQ.EOS), F.lit(SQ.BOS)), "c", F.array(F.lit(SQ.EOS)))
    inp, tgt, mask, cut = SQ.decoder_shift(dec, MAX_LEN)
    return e.select("idx", SQ.ids_text(inp).alias("dec_in"), SQ.ids_text(tgt).alias("dec_target"),
                    SQ.ids_text(mask).alias("dec_mask"), cut.alias("truncated"))


_LAB = f"c || [{SQ.EOS}]"
_LABELS = ("lab", f"""SELECT idx, len({_LAB}) > {MAX_LEN} AS truncated,
  list_transform({_pad_sql(_LAB, SQ.PAD)}, lambda x: CASE WHEN x = {SQ.PAD} THEN {SQ.IGNORE} ELSE x END) AS labels FROM enc""")


def labels_df(spark, d):
    e, vocab = encoded(spark, d)
    labels, trunc = SQ.truncate_labels(F.concat("c", F.array(F.lit(SQ.EOS))), MAX_LEN)
    return e.select("idx", trunc.alias("truncated"), labels.alias("labels")), vocab


@query("truncate_labels", with_ctes(["valid"], [_VOCAB, _ENC, _LABELS],
                                    "SELECT idx, truncated, array_to_string(labels, ',') AS labels FROM lab"))
def truncate_labels(spark, d):
    lab, _ = labels_df(spark, d)
    return lab.select("idx", "truncated", SQ.ids_text(F.col("labels")).alias("labels"))


_GEN = f"[{SQ.BOS}] || p1 || [{SQ.AND}] || p2 || [{SQ.SO}]"


@query("left_pad", with_ctes(["valid"], [_VOCAB, _ENC], f"""
SELECT idx, len({_GEN}) AS n_ids,
       array_to_string(list_transform(range(greatest({MAX_LEN} - len({_GEN}), 0)), lambda z: {SQ.EOS}) || {_GEN}, ',') AS ids
FROM enc"""))
def left_pad(spark, d):
    """T9, causal style: the pad id of a causal model is its end id."""
    e, _ = encoded(spark, d)
    gen = F.concat(F.array(F.lit(SQ.BOS)), "p1", F.array(F.lit(SQ.AND)), "p2", F.array(F.lit(SQ.SO)))
    return e.select("idx", F.size(gen).cast("long").alias("n_ids"), SQ.ids_text(SQ.pad_left(gen, MAX_LEN, SQ.EOS)).alias("ids"))


def _decode_sql(ids: str) -> str:
    return f"""
SELECT e.idx, coalesce(t.text, '') AS text FROM enc e LEFT JOIN (
  SELECT x.idx, string_agg(coalesce(vo.token, '{SQ.SPECIALS[SQ.UNK]}'), ' ' ORDER BY x.p) AS text FROM (
    SELECT idx, unnest({ids}) AS id, unnest(range(1, len({ids}) + 1)) AS p FROM enc) x
  LEFT JOIN vocab vo ON x.id = vo.id WHERE x.id >= {len(SQ.SPECIALS)} GROUP BY x.idx) t ON e.idx = t.idx"""


@query("decode_ids", with_ctes(["valid"], [_VOCAB, _ENC], _decode_sql(_LAB)))
def decode_ids(spark, d):
    """Labels of any length, padded with -100 and not cut, back to text."""
    e, vocab = encoded(spark, d)
    labels = F.concat("c", F.array(F.lit(SQ.EOS)))
    padded = F.concat(labels, F.array_repeat(F.lit(SQ.IGNORE), F.greatest(F.lit(MAX_LEN) - F.size(labels), F.lit(0))))
    return SQ.decode(e.select("idx", padded.alias("labels")), "idx", "labels", vocab, "text")


@query("decode_causal", with_ctes(["valid"], [_VOCAB, _ENC], _decode_sql("c")))
def decode_causal(spark, d):
    """T10, causal style: the left-padded prompt comes back in front of the text and is skipped."""
    e, vocab = encoded(spark, d)
    prompt = SQ.pad_left(F.concat(F.array(F.lit(SQ.BOS)), "p1", F.array(F.lit(SQ.AND)), "p2", F.array(F.lit(SQ.SO))), MAX_LEN, SQ.EOS)
    out = e.select("idx", F.concat(prompt, "c", F.array(F.lit(SQ.EOS))).alias("ids"), F.size(prompt).alias("n"))
    return SQ.decode(out, "idx", "ids", vocab, "text", skip_prefix=F.col("n"))
