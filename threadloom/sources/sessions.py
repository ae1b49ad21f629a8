"""Changes to single transcript files: rename, copy, delete and look-up.

They touch a few files on the driver's file system and no data of the corpus.
"""

from __future__ import annotations

import json
import re
import shutil
from pathlib import Path

_SAFE = re.compile(r"[A-Za-z0-9-]+")


def find(root: str | Path, session: str) -> list[Path]:
    """All copies of a session's transcript, one folder below ``root``."""
    if not _SAFE.fullmatch(session):
        raise ValueError(f"no session id: {session!r}")
    return sorted(p for p in Path(root).glob(f"*/{session}.jsonl") if p.is_file())


def rename(path: str | Path, title: str) -> None:
    """Appends the title as two records, after a line end if the last line lacks one."""
    path = Path(path)
    records = ({"type": "custom-title", "customTitle": title, "sessionId": path.stem}, {"type": "agent-name", "agentName": title, "sessionId": path.stem})
    with path.open("rb+") as f:
        size = f.seek(0, 2)
        if size and (f.seek(size - 1), f.read(1))[1] != b"\n":
            f.write(b"\n")
        f.seek(0, 2)
        for r in records:
            f.write(json.dumps(r, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")


def copy(path: str | Path, project_dir: str | Path) -> Path:
    """Copies a transcript and its folder into another project; the copy's path."""
    path, project_dir = Path(path), Path(project_dir)
    project_dir.mkdir(parents=True, exist_ok=True)
    target = project_dir / path.name
    if target.exists():
        raise FileExistsError(target)
    shutil.copy2(path, target)
    beside = path.with_suffix("")
    if beside.is_dir():
        shutil.copytree(beside, target.with_suffix(""), dirs_exist_ok=True)
    return target


def delete(root: str | Path, session: str) -> int:
    """Deletes all copies of a session and their folders; how many files there were."""
    found = find(root, session)
    if not found:
        raise FileNotFoundError(session)
    for path in found:
        path.unlink()
        beside = path.with_suffix("")
        if beside.is_dir():
            shutil.rmtree(beside)
    return len(found)
