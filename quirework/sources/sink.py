"""Carrying out plans on a library's folders. Plans are DataFrames; only what they decided is touched here, row by row, on the one
machine that holds the folders."""

from __future__ import annotations

import os
import shutil
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame


def write_file(path: str, content: str | bytes) -> None:
    """The old file becomes .bak, the new one appears whole or not at all."""
    p, raw = Path(path), content.encode() if isinstance(content, str) else content
    if p.exists():
        shutil.copy2(p, f"{p}.bak")
    tmp = Path(f"{p}.tmp")
    tmp.write_bytes(raw)
    os.replace(tmp, p)


def move(source: str, dest: str, root: str) -> tuple[str, str]:
    """(place, action): an occupied place gets the smallest free ' (dup n)'; parents left empty go, up to the root."""
    src, to, n = Path(source), Path(dest), 0
    if not src.exists():
        return dest, "error"
    if src.resolve() == to.resolve():
        return dest, "already_correct"
    while to.exists():
        n += 1
        to = Path(f"{dest} (dup {n})")
    to.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(src, to)
    parent = src.parent
    while parent != Path(root) and Path(root) in parent.parents and not any(parent.iterdir()):
        parent.rmdir()
        parent = parent.parent
    return str(to), "collision_renamed" if n else "moved"


def delete(folders: list[str], snapshot: str) -> list[tuple[str, str]]:
    """All folders into one archive, then away; a failing archive does not block."""
    try:
        with tarfile.open(snapshot, "w:gz") as tar:
            for f in folders:
                if os.path.isdir(f):
                    tar.add(f, arcname=os.path.basename(f))
    except OSError:
        pass
    out = []
    for f in folders:
        try:
            shutil.rmtree(f)
            out.append((f, "deleted"))
        except OSError as e:
            out.append((f, f"error: {e}"))
    return out


def carry_out(plan: DataFrame, root: str, snapshot: str, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """(source, place, outcome) of a plan (pos, source, dest, step) in order of pos; rows stream to the driver one partition at a time."""
    out, gone = [], []
    for r in plan.orderBy("pos").select("source", "dest", "step").toLocalIterator():
        if r.step == "deleted":
            gone.append(r.source)
        elif r.step == "applied":
            out.append((r.source, *((r.dest, "planned") if dry_run else move(r.source, r.dest, root))))
        else:
            out.append((r.source, r.source, r.step))
    return out + ([(f, f, "planned deletion") for f in gone] if dry_run else [(f, f, s) for f, s in (delete(gone, snapshot) if gone else [])])
