"""Tokenisers and prompt templates (T1-T4) as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_WS = "[ \\t\\n\\r\\f\\x0B]+"


def _tokens_of(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def ws_normalized(text: Column) -> Column:
    """Whitespace tokens joined by single spaces (runs of ASCII blanks collapse, ends trimmed)."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_WS}|{_WS}$", ""), _WS, " ")


def ws_tokens(text: Column) -> Column:
    """Whitespace tokens as Python's ``str.split()`` gives them for ASCII blanks:
    no empty tokens, leading/trailing blanks ignored.  Built-in expressions only (no lambda),
    so it stays inside whole-stage codegen; one pass over the text."""
    return F.array_remove(F.split(text, _WS), "")



def rouge_normalized(text: Column) -> Column:
    """ROUGE tokens joined by single spaces: lower case, every run of characters outside
    [a-z0-9] is a break."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), "^ | $", "")


def rouge_tokens(text: Column) -> Column:
    """ROUGE tokens (see ``rouge_normalized``)."""
    return _tokens_of(rouge_normalized(text))


# Special tokens and prompt words used by the three prompt styles.
BOS = "<s>"
EOS = "</s>"
SEP = "</s>"
MASK = "<mask>"
PAD = "<pad>"
T5_PREFIX = "Syllogistic: "
T5_SEP = " <sep> "
GPT2_BOS = "<|endoftext|>"
GPT2_EOS = "<|endoftext|>"
GPT2_AND = "<|and|>"
GPT2_SO = "<|so|>"


def prompt_columns(target: str, premise_1: Column, premise_2: Column, conclusion: Column):
    """(A, B, Y) for a generation target: conclusion -> (p1, p2, c); prem1 -> (p2, c, p1);
    prem2 -> (p1, c, p2)."""
    if target == "conclusion":
        return premise_1, premise_2, conclusion
    if target == "prem1":
        return premise_2, conclusion, premise_1
    if target == "prem2":
        return premise_1, conclusion, premise_2
    raise ValueError(f"unknown target {target!r}")


def target_case(target: Column, premise_1: Column, premise_2: Column, conclusion: Column):
    """Same as prompt_columns, with the target held in a column (one plan for all targets)."""
    a = F.when(target == "prem1", premise_2).otherwise(premise_1)
    b = F.when(target == "conclusion", premise_2).otherwise(conclusion)
    y = (F.when(target == "prem1", premise_1).when(target == "prem2", premise_2).otherwise(conclusion))
    return a, b, y


def prompt_encdec(a: Column, b: Column, y: Column, bos=BOS, eos=EOS, sep=SEP, mask=MASK):
    """Encoder-decoder style: enc = bos+A+sep+" "+B+eos+mask, dec = eos+bos+Y+eos."""
    enc = F.concat(F.lit(bos), a, F.lit(sep), F.lit(" "), b, F.lit(eos), F.lit(mask))
    dec = F.concat(F.lit(eos), F.lit(bos), y, F.lit(eos))
    return enc, dec


def prompt_prefix(a: Column, b: Column, y: Column, prefix=T5_PREFIX, sep=T5_SEP):
    """Prefix style: "Syllogistic: "+A+" <sep> "+B -> Y."""
    return F.concat(F.lit(prefix), a, F.lit(sep), b), y


def prompt_causal(a: Column, b: Column, y: Column, bos=GPT2_BOS, eos=GPT2_EOS, and_=GPT2_AND, so=GPT2_SO):
    """Causal style: full = bos+" "+A+and+" "+B+" "+so+Y+eos; generation input = full up to so."""
    gen_input = F.concat(F.lit(bos), F.lit(" "), a, F.lit(and_), F.lit(" "), b, F.lit(" "), F.lit(so))
    full = F.concat(gen_input, y, F.lit(eos))
    return full, gen_input, y
