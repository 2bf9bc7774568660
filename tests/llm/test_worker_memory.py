"""What stages leave in a Python worker that outlives them, in a session of one worker."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

SESSION = """
import json, re, sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from compare import local_session

spark = local_session("1")
spark.conf.set("spark.sql.shuffle.partitions", "1")


def worker(run, schema):
    return spark.range(1, numPartitions=1).mapInArrow(run, schema).collect()


def anonymous(batches):
    import os
    for _ in batches:
        pass
    from marketlens.llm import packing
    held = int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1])
    yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [held // 1024], "remembered": [len(packing._WORD_IDS)]})


def probe():
    return worker(anonymous, "pid long, mb long, remembered long")[0].asDict()


def fill(batches):
    # 200 MB in small blocks, all freed; one that stays behind them keeps the C library from returning the rest
    import marketlens
    for _ in batches:
        pass
    blocks = [np.ones(2000, np.uint8) for _ in range(100_000)]
    marketlens.stays = [np.ones(2000, np.uint8) for _ in range(10)]
    del blocks
    yield pa.RecordBatch.from_pydict({"id": [1]})


out = {}
"""
PACKING = """
from marketlens.llm import packing
from marketlens.llm.common import materialise

docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
tokens = materialise(packing.tokenized(docs), "test-tokens")
out["tokenized"] = probe()
worker(fill, "id long")
out["filled"] = probe()
packing.document_frequencies(tokens)
out["after"] = probe()
"""
JACCARD = """
from marketlens.llm.common import materialise
from marketlens.llm.jaccard import _sets_and_counts

docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("version"), F.lit("a b c d e f").alias("text"))
worker(fill, "id long")
out["filled"] = probe()
docs.coalesce(1).mapInArrow(_sets_and_counts(5), "doc_id long, version long, n long, class binary, block int, counts binary").collect()
out["after"] = probe()
"""


def measured(script: str) -> dict:
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run(
        [sys.executable, "-c", SESSION + script + "print('OUT' + json.dumps(out))"], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-3000:]
    out = json.loads(done.stdout.rpartition("OUT")[2])
    assert len({x["pid"] for x in out.values()}) == 1
    return out


def test_packing_forgets_words_when_ids_are_counted():
    out = measured(PACKING)
    assert out["tokenized"]["remembered"] == 1
    assert out["after"]["remembered"] == 0


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
@pytest.mark.parametrize("script", [PACKING, JACCARD], ids=["packing", "jaccard"])
def test_free_memory_of_a_worker_goes_back(script):
    out = measured(script)
    assert out["after"]["mb"] < out["filled"]["mb"] - 100
