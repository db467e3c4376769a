"""Identity and safety of runs: fingerprints, reserved outputs, one run at a time. Driver-side; no data passes through."""

from __future__ import annotations

import fcntl
import hashlib
import json
from collections.abc import Collection, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from pathlib import Path

#: Keys that never count towards a run's identity.
SECRET_KEYS = frozenset(["api_key", "key", "token", "password"])


#: Lists under these keys are sets of names: their order and repeats don't matter.
SET_KEYS = frozenset(["sites", "site_names", "domains"])


def normalized(config: Mapping[str, object], set_keys: Collection[str] = SET_KEYS) -> dict[str, object]:
    """Keys sorted; sets, and lists under set_keys, sorted without repeats; secrets left out at any depth. Other lists keep their order."""
    out: dict[str, object] = {}
    for key in sorted(config.keys() - SECRET_KEYS):
        value = config[key]
        if isinstance(value, Mapping):
            out[key] = normalized(value, set_keys)
        elif isinstance(value, (set, frozenset)) or (key in set_keys and isinstance(value, (list, tuple))):
            out[key] = sorted(set(value))
        else:
            out[key] = value
    return out


def fingerprint(config: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(normalized(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def file_hash(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def reusable(root: str | Path, path: str | Path, expected: str) -> bool:
    """A file below root whose content still has the expected hash."""
    place = Path(path).resolve()
    return place.is_relative_to(Path(root).resolve()) and place.is_file() and file_hash(place) == expected


def reserve(paths: Sequence[str | Path]) -> list[Path]:
    """Create every file anew. Whatever goes wrong on the way, none of those made here stays."""
    places = [Path(path) for path in paths]
    with ExitStack() as undo:
        for place in places:
            place.parent.mkdir(parents=True, exist_ok=True)
            place.touch(exist_ok=False)
            undo.callback(place.unlink, missing_ok=True)
        undo.pop_all()
    return places


@contextmanager
def run_lock(path: str | Path) -> Iterator[None]:
    """Held by one process at a time; fails at once if another holds it."""
    with open(path, "a") as file:
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as error:
            raise RuntimeError(f"another run holds {path}") from error
        yield
