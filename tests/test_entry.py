"""The entry file without what the training-data subpackage needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_other_queries_do_without_the_subpackage():
    code = "import sys; sys.modules['evenkeel.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"
    code = code.replace("'evenkeel.llm'", "'xxhash'")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"
