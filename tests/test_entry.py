import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(before: str = "") -> set[str]:
    code = f"import sys\n{before}\nimport __spark_entry__ as e\n" \
           "assert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                          check=True)
    return set(done.stdout.split())


def test_entry_works_without_the_corpus_subpackage():
    from patronage.plans.catalog import QUERIES
    gone = "sys.modules['patronage.llm'] = sys.modules['corpus_pipeline'] = None"
    assert names(gone) == set(QUERIES)
    assert names() >= set(QUERIES)
    # A library that only the corpus queries need takes only them away.
    assert names("sys.modules['zstandard'] = None") == set(QUERIES)


def test_flagship_query(spark, folder):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() == 80
