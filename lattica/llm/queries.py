"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from lattica.llm.common import table
from lattica.llm import ann, langid, lm, mixing, pieces, pii, simhash, toxicity, warc, winnow


def op1_simhash(spark, sf_dir):
    return simhash.op1(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_langid(spark, sf_dir):
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_lm(spark, sf_dir):
    return lm.op10(table(spark, sf_dir, "documents"))


def op3_winnowing(spark, sf_dir):
    return winnow.op3(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.op4(table(spark, sf_dir, "pages"))


def op8_pfair(spark, sf_dir):
    return mixing.op8(table(spark, sf_dir, "documents"))


def op7_surrogates(spark, sf_dir):
    return pii.op7(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op6_pieces(spark, sf_dir):
    return pieces.op6(table(spark, sf_dir, "documents"))


def op2_ann(spark, sf_dir):
    return ann.op2(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_winnowing": op3_winnowing,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_pieces": op6_pieces,
    "op7_surrogates": op7_surrogates,
    "op8_pfair": op8_pfair,
    "op9_langid": op9_langid,
    "op10_lm": op10_lm,
}

ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE, "op8_pfair": mixing.ORACLE}
