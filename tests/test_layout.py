"""The tests themselves."""

import subprocess
import sys
from pathlib import Path


def test_every_module_is_collected():
    """One run takes the tests of both folders, also of modules of the same name."""
    pytest = [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", str(Path(__file__).parent)]
    run = subprocess.run(pytest, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-1000:]
    assert all(str(p.name) + "::" in run.stdout for p in Path(__file__).parent.rglob("test_*.py"))
