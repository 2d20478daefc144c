"""Small files that the driver reads: configuration, approvals, environment."""

from __future__ import annotations

from pathlib import Path

DEFAULTS = {"version": 1, "scan": {"include": ["**/*"], "exclude": []}, "tools": {}, "dependencies": {}, "tool_routing": {"profiles": {}}}


def load(path: str) -> dict:
    """A missing file, or version 0, gives the defaults; another version than 1 is an error."""
    import yaml

    file = Path(path)
    got = (yaml.safe_load(file.read_text()) or {}) if file.exists() else {}
    if got.get("version", 0) == 0:
        return DEFAULTS | {k: v for k, v in got.items() if k != "version"}
    if got["version"] != 1:
        raise ValueError(f"unsupported version {got['version']}")
    return DEFAULTS | got


def save(path: str, config: dict) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(config, sort_keys=True))


def load_approvals(path: str) -> dict[str, dict]:
    """Name to state, approved_by, approved_at, content_hash."""
    import yaml

    file = Path(path)
    got = (yaml.safe_load(file.read_text()) or {}) if file.exists() else {}
    return {"tools": got.get("tools") or {}, "resources": got.get("resources") or {}}


save_approvals = save


def load_dotenv(folder: str) -> dict[str, str]:
    out = {}
    file = Path(folder) / ".env"
    for line in file.read_text().splitlines() if file.exists() else ():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            v = v.strip()
            out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out
