"""The rest of the library in a copy of the repository that has no corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPOSITORY = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__, voxlake
from pathlib import Path
assert Path(voxlake.__file__).is_relative_to(Path.cwd())
found = __spark_entry__.queries()
assert found and all(name.startswith("q_") for name in found)
assert set(__spark_entry__.oracle_sql()) <= set(found)
"""


def test_a_copy_without_the_corpus_folders_imports(tmp_path):
    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPOSITORY, copy, ignore=left_out)
    assert not (copy / "voxlake" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
