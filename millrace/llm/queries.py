"""The registered queries of the operators, and the SQL that checks them where SQL can say the same."""

from __future__ import annotations

from public_tokenizers import path as tokenizer

from millrace.queries.base import Registry
from millrace.runtime import load

from . import audit, sharding

R = Registry()


@R.add("op1_quality")
def op1_quality(spark, folder):
    from .quality import op1

    return op1(spark, load(spark, folder, "documents"), load(spark, folder, "labels"))


@R.add("op2_bpe")
def op2_bpe(spark, folder):
    from .bpe import op2

    return op2(spark, load(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@R.add("op6_packing")
def op6_packing(spark, folder):
    from .packing import op6

    return op6(spark, load(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@R.add("op7_toxicity")
def op7_toxicity(spark, folder):
    from .toxicity import op7

    return op7(spark, load(spark, folder, "documents"), load(spark, folder, "labels"))


@R.add("op5_winnow")
def op5_winnow(spark, folder):
    from .winnow import op5

    return op5(spark, load(spark, folder, "documents"))


@R.add("op10_warc")
def op10_warc(spark, folder):
    from .warc import op10

    return op10(spark, load(spark, folder, "pages"))


@R.add("op9_ann")
def op9_ann(spark, folder):
    from .ann import op9

    return op9(spark, load(spark, folder, "embeddings"))


@R.add("op8_sharding", sharding.SQL)
def op8_sharding(spark, folder):
    return sharding.op8(spark, load(spark, folder, "documents"))


@R.add("op3_lm")
def op3_lm(spark, folder):
    from .lm import op3

    return op3(spark, load(spark, folder, "documents"))


@R.add("op4_jaccard")
def op4_jaccard(spark, folder):
    from .jaccard import op4

    return op4(spark, load(spark, folder, "documents"))


@R.add("op11_audit", audit.SQL)
def op11_audit(spark, folder):
    return audit.op11(spark, load(spark, folder, "documents"), load(spark, folder, "labels"))


@R.add("op12_neardup")
def op12_neardup(spark, folder):
    from .neardup import op12

    return op12(spark, load(spark, folder, "embeddings"))


@R.add("op13_repair")
def op13_repair(spark, folder):
    from .repair import op13

    return op13(spark, load(spark, folder, "conversations"))
