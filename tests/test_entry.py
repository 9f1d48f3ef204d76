"""The entry without the optional subpackage, and with it where a library that it needs is absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(sorted(entry.queries()), sorted(entry.oracle_sql()))
"""


def listed(*names):
    done = subprocess.run([sys.executable, "-c", HIDE.format(names=set(names))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_other_queries_do_not_need_the_subpackage():
    for gone in (["amberline.llm"], ["xxhash", "tokenizers", "public_tokenizers"], ["amberline.llm.queries"]):
        out = listed(*gone)
        assert "'response_by_segment'" in out and "'op1_toxicity'" not in out and "'pipeline'" not in out
    assert "'robots_gate'" in listed("corpus_pipeline") and "'pipeline'" not in listed("corpus_pipeline")
