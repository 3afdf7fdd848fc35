"""Review prompts: built in, from one Markdown file, or from a folder of them."""

from __future__ import annotations

from pathlib import Path

BUILTIN = {
    "architecture": "Find hub and god files, import cycles and imports that cross layers the wrong way. Count before you report.",
    "bugs": "Find functions whose callers and callees disagree about what they take or return.",
    "maintainability": "Find the longest functions, names declared twice, exports nobody uses and deep nesting.",
    "security": "Find paths from public functions to risky callees, and secrets in the source.",
}


def load(path: str | None = None) -> list[tuple[str, str]]:
    """``(name, text)`` in order of name; a path without prompts is an error."""
    if path is None:
        return sorted(BUILTIN.items())
    place = Path(path)
    files = sorted(place.glob("*.md")) if place.is_dir() else [place]
    found = [(f.stem, f.read_text(encoding="utf-8")) for f in files]
    if not found:
        raise ValueError(f"no prompts in {path}")
    return found


def export(folder: str) -> list[str]:
    """Writes the built-in prompts to a folder; refuses if one of them is there already."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    targets = {place / f"{name}.md": text for name, text in sorted(BUILTIN.items())}
    for target in targets:
        if target.exists():
            raise FileExistsError(target)
    for target, text in targets.items():
        target.write_text(text + "\n", encoding="utf-8")
    return [str(t) for t in targets]
