"""The registered queries stand without the training-data subpackage and its libraries."""
from __future__ import annotations

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("blocked", ["chartlake.llm", "public_tokenizers", "tokenizers", "corpus_pipeline"])
def test_queries_without_an_importable_module(blocked):
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {blocked!r} or name.startswith({blocked + '.'!r}):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "from checks import QUERIES\n"
        "assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
        f"assert ('pipeline' in e.queries()) == ({blocked!r} == 'tokenizers')\n"  # imported by tasks only
        "print('fine')\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr[-2000:]
