"""The entry file without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'z1_letters' in e.queries(), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"


def test_survey_part_stands_alone(tmp_path):
    for name in ("tabuloom", "study_queries"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for extra in (None, "corpus_pipeline.py"):
        if extra and (ROOT / extra).exists():
            shutil.copy(ROOT / extra, tmp_path)
        done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        n, twins, flagship, more = done.stdout.split(" ", 3)
        assert int(n) > 100 and int(twins) > 100 and flagship == "True" and more.strip() == "[]"
