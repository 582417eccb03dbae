"""Settings in YAML: genre assignments, weight overrides, defaults, first and last tracks of folders."""

from __future__ import annotations

import os
from pathlib import Path

import yaml

from segue.functions.exprs import KNOWN_GENRES


def _load(path: str) -> dict:
    """The mapping in a file; empty if the file is missing or unreadable."""
    try:
        found = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError):
        return {}
    return found if isinstance(found, dict) else {}


def genre_map(path: str) -> dict[str, str]:
    """Manual assignments of known genres, by path or file name."""
    given = _load(path).get("manual_assignments") or {}
    pairs = {k: v.strip().lower() for k, v in given.items() if isinstance(k, str) and isinstance(v, str)} if isinstance(given, dict) else {}
    return {k: v for k, v in pairs.items() if v in KNOWN_GENRES}


def weight_overrides(path: str) -> dict[str, float]:
    """The weights that a file gives; nulls are left out."""
    given = _load(path).get("weights") or {}
    return {k: float(v) for k, v in given.items() if v is not None}


def settings(path: str, defaults: dict) -> dict:
    """Defaults, with what a file says."""
    return defaults | _load(path)


def _save(path: str, found: dict) -> None:
    """Puts a file in place of the old one when it is whole."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(f"{path}.new").write_text(yaml.safe_dump(found, allow_unicode=True, sort_keys=True))
    os.replace(f"{path}.new", path)


def _overrides(found: dict, folder: str) -> tuple[dict, str]:
    given = found.get("track_overrides")
    return (given if isinstance(given, dict) else {}), os.path.realpath(folder)


def folder_override(path: str, folder: str) -> dict[str, str | None]:
    """The tracks that are to be first and last for a folder; null where none is set."""
    given, key = _overrides(_load(path), folder)
    own = given.get(key) if isinstance(given.get(key), dict) else {}
    return {end: own.get(end) or None for end in ("first", "last")}


def set_folder_override(path: str, folder: str, first: str | None = None, last: str | None = None) -> None:
    """Sets a folder's first or last track; what is null stays as it is."""
    found = _load(path)
    given, key = _overrides(found, folder)
    own = given.get(key) if isinstance(given.get(key), dict) else {}
    _save(path, found | {"track_overrides": given | {key: own | {end: track for end, track in (("first", first), ("last", last)) if track is not None}}})


def clear_folder_override(path: str, folder: str) -> None:
    """Takes away what is set for a folder."""
    found = _load(path)
    given, key = _overrides(found, folder)
    _save(path, found | {"track_overrides": {k: v for k, v in given.items() if k != key}})
