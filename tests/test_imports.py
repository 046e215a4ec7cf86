"""Modules load before a session exists."""

import subprocess
import sys
from pathlib import Path


def test_no_session_is_needed_to_import():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
