"""Executors have no copy of the package: its functions must travel with their code."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from domloom.session import build_session
from domloom import parse_pages
spark = build_session("shipping", 1)
pages = spark.createDataFrame([(1, "<p>a")], "page_id bigint, html string")
print("elements:", len(parse_pages(pages).first().nodes))
"""


def test_workers_need_no_installed_package(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=180,
        env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"},
    )
    assert "elements: 3" in run.stdout, run.stderr[-2000:]
