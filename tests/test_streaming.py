"""The streaming incident count equals the batch count over the same files."""
import tempfile

from pyspark.sql import functions as F

from vendorlens.sources.adapter import load_inputs, x_supplier
from vendorlens.streaming.incidents import start

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    import shutil
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{SF}/events.parquet", src / "part-0.parquet")
    got = {}

    def sink(batch, _id):
        for r in batch.collect():
            got[(r["supplier_id"], r["fiscal_quarter"], r["severity"])] = r["n"]

    q = start(spark, str(src), x_supplier(spark, SF), str(tmp_path / "ckpt"), sink)
    q.processAllAvailable()
    shutil.copy(f"{SF}/events.parquet", src / "part-1.parquet")  # delivered again
    q.processAllAvailable()
    q.stop()
    batch = load_inputs(spark, SF).event.groupBy("supplier_id", "fiscal_quarter", "severity").count()
    exp = {(r[0], r[1], r[2]): r[3] for r in batch.collect()}
    assert got == exp
