"""The registered queries of the numbered operators and their SQL."""

import functools
import os

import noticeflow
from noticeflow.llm.bpe import op3_bpe
from noticeflow.llm.language import op13_language
from noticeflow.llm.masked import op9_pseudo_likelihood
from noticeflow.llm.middle import OP12_SQL, op12_fill_middle
from noticeflow.llm.nearest import op4_nearest
from noticeflow.llm.neardup import op7_neardup
from noticeflow.llm.packing import op6_packing
from noticeflow.llm.pseudonyms import op1_pseudonyms
from noticeflow.llm.quality import op8_quality
from noticeflow.llm.repair import op11_repair
from noticeflow.llm.rules import op5_rules
from noticeflow.llm.sharding import op2_hash_ring
from noticeflow.llm.spans import OP10_SQL, op10_spans

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(noticeflow.__file__)))


def importable(query):
    """With a local master, Python workers find this package wherever the driver was started; clusters get it installed."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        env = spark.sparkContext.environment
        if spark.sparkContext.master.startswith("local") and _ROOT not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: importable(f)
    for f in (
        op1_pseudonyms,
        op2_hash_ring,
        op3_bpe,
        op4_nearest,
        op5_rules,
        op6_packing,
        op7_neardup,
        op8_quality,
        op9_pseudo_likelihood,
        op10_spans,
        op11_repair,
        op12_fill_middle,
        op13_language,
    )
}

ORACLE = {"op10_spans": OP10_SQL, "op12_fill_middle": OP12_SQL}
