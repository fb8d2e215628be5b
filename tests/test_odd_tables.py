"""Queries against their SQL on small tables with what the driver's tables lack: nulls, empty texts, repeated rows."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.oracle import DATA, TABLES, agree
from trailmetric import plans
from trailmetric.functions import text as tx
from trailmetric.sources import parsers


def agrees(spark, folder: Path, name: str, **changed: pa.Table) -> None:
    """The query equals its SQL over the driver's tables with some of them changed."""
    folder.mkdir()
    for t in TABLES:
        if t in changed:
            pq.write_table(changed[t], folder / f"{t}.parquet")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    agree(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], str(folder))


def test_heuristic_grade(spark, tmp_path):
    signs = [" ".join((*tx.SUCCESS[:s], *tx.FAILURE[:f], *tx.API_ERRORS[:e])) for s in range(7) for f in range(9) for e in range(2)]
    texts = [None, "", " ", "\n", "FAİLED TO", "faıled to", "FAILED TO", "could\nnot", "can’t", "ΣfoundΣ", "K timeout", *signs]
    agrees(spark, tmp_path / "t", "heuristic_grade", documents=pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))


def test_tool_similarity(spark, tmp_path):
    # Names alike but for the number, a family of one, repeated rows, and more alike tools in one class than are listed.
    rows = [(k, ("red rod", "red gear", "Old rod", "get", "the list by rod", "results fixtures")[k % 5 if k < 40 else 5], "Brand#1" if k != 7 else "Brand#2", k % 3 if k < 60 else 9) for k in range(90)]
    rows += rows[3:9] + rows[3:5] + rows[85:]
    names = ("p_partkey", "p_name", "p_brand", "p_size")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
    part = pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})
    agrees(spark, tmp_path / "t", "tool_similarity", part=part)


def test_tools_of_one_family(spark):
    """900 million pairs of tools, but two classes."""
    tools = spark.range(30000).selectExpr("concat(if(id < 15000, 'get', 'list'), '_item_', lpad(id, 5, '0')) AS name")
    found = parsers.tool_similarity(tools.withColumns({"api_family": parsers.tool_family(F.col("name")), "keywords": parsers.tool_words(F.col("name"))})).cache()
    # A word that is taken for another is worth more than the same word again.
    assert {(r.kind, r.substitute, r.score, r["rank"]): r.n for r in found.groupBy(F.split("tool", "_")[0].alias("kind"), "substitute", "score", "rank").agg(F.count("*").alias("n")).collect()} == {
        (kind, f"{other}_item_{first + i:05}", 1.4, i + 1): 15000 for kind, other, first in (("get", "list", 15000), ("list", "get", 0)) for i in range(3)
    }
