"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
import os

import pytest

from nearopt import storage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_optional_parts_can_be_missing(tmp_path, pipeline):
    import shutil

    # The folders go, with the pipeline or without it.
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bands_documents' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "fine" in done.stdout, done.stderr


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
def test_entry_and_a_few_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 87
    for name in ("ridge_fit_part", "ambiguity_rate", "discrepancy_pairs"):
        assert e.queries()[name](spark, SMALL).count() == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())


def test_kept_text_features_follow_their_files(spark, tmp_path):
    from nearopt.plans import catalog

    def stage(n):
        spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")

    stage(5)
    first = catalog.text_table(spark, str(tmp_path))
    assert first.count() == 5 and catalog.text_table(spark, str(tmp_path)) is first
    stage(8)
    assert catalog.text_table(spark, str(tmp_path)).count() == 8
