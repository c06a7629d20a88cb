"""Integration with coding assistants: a note on how to ask the map, and a hook that points to it.

``install`` writes three artifacts and may be repeated: a note of its own, a block between markers in a
page that others write too, and an entry in a settings file that keeps all else.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import TextIO

from graphloom import __name__ as PROGRAM
from graphloom import build

BEGIN, END = f"<!-- {PROGRAM}: begin -->", f"<!-- {PROGRAM}: end -->"
NOTE = f"""# Asking the map

`{build.FOLDER}/MAP.md` names the hubs, districts and links of this code. `python -m {PROGRAM}.cli query "words"` prints the
part of the graph that answers a question, within a budget of tokens; `python -m {PROGRAM}.cli update` renews it after changes.
"""
NUDGE = f"A map of this code is in {build.FOLDER}/MAP.md; ask it (python -m {PROGRAM}.cli query) before searching file by file."


def write(path: Path, text: str) -> str:
    """Writes a file if its text differs: ``created``, ``updated`` or ``unchanged``."""
    old = path.read_text(encoding="utf-8") if path.exists() else None
    if old == text:
        return "unchanged"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return "created" if old is None else "updated"


def merged_page(old: str, block: str = NOTE) -> str:
    """A page with the block between the markers, in its old place or at the end."""
    own = f"{BEGIN}\n{block}{END}\n"
    if BEGIN in old and END in old:
        before, rest = old.split(BEGIN, 1)
        return before + own + rest.split(END, 1)[1].removeprefix("\n")
    return old + ("\n" if old and not old.endswith("\n") else "") + ("\n" if old else "") + own


def merged_settings(old: str, command: str) -> str:
    """Settings with one entry of the hook; a text that is no JSON object is an error, not overwritten."""
    settings = json.loads(old) if old.strip() else {}
    if not isinstance(settings, dict):
        raise ValueError("the settings file holds no JSON object")
    hooks = settings.setdefault("hooks", [])
    if command not in hooks:
        hooks.append(command)
    return json.dumps(settings, indent=2, ensure_ascii=False) + "\n"


def install(root: str, page: str = "AGENTS.md", hook: bool = False) -> dict[str, str]:
    """What happened to each artifact under a root."""
    base = Path(root)
    read = lambda p: p.read_text(encoding="utf-8") if p.exists() else ""
    done = {"note": write(base / build.FOLDER / "NOTE.md", NOTE), "page": write(base / page, merged_page(read(base / page)))}
    if hook:
        settings = base / build.FOLDER / "settings.json"
        done["hook"] = write(settings, merged_settings(read(settings), f"python -m {PROGRAM}.cli hook"))
    return done


def nudge(given: TextIO, out: TextIO, here: str = ".") -> None:
    """Points to the map if the folder of the event (``cwd``, else ``here``) has one; faulty input says nothing. Never fails."""
    try:
        event = json.loads(given.read(1 << 20) or "{}")
        folder = event.get("cwd") if isinstance(event, dict) and isinstance(event.get("cwd"), str) else None
        if (Path(folder or here) / build.FOLDER / build.MAP).exists():
            json.dump({"context": NUDGE}, out)
    except (OSError, ValueError):
        return
