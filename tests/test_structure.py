from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "stacklore"


def test_nothing_outside_imports_llm():
    for file in ROOT.rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+stacklore\.llm", file.read_text(), re.M), file


def test_no_local_checkpoint_or_fixed_temporary_folder():
    for file in ROOT.rglob("*.py"):
        text = file.read_text()
        assert "localCheckpoint" not in text and "/tmp" not in text, file
        assert ".persist(" not in text and ".cache()" not in text, file
        if file.name != "storage.py":  # there only for sessions on a local master
            assert not re.search(r"\btempfile\b|mkdtemp|gettempdir", text), file
