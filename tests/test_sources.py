"""Prompts, language names and ignore rules."""

import pytest

from lodestone.sources import files, prompts


def test_prompts(tmp_path):
    assert [n for n, _ in prompts.load()] == sorted(prompts.BUILTIN)
    prompts.export(str(tmp_path / "p"))
    assert len(prompts.load(str(tmp_path / "p"))) == 4
    assert prompts.load(str(tmp_path / "p/bugs.md"))[0][0] == "bugs"
    with pytest.raises(FileExistsError):
        prompts.export(str(tmp_path / "p"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no prompts"):
        prompts.load(str(tmp_path / "none"))


def test_languages():
    assert files.parse_languages(" rust, nope,python,rust ") == ["rust", "python", "rust"]


def test_ignore_rules(tmp_path):
    for name in ("a.py", "keep.py", "x/gen.py", "x/deep/b.py", "out/c.py", ".hidden/d.py", "x/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / ".gitignore").write_text("# no\n/out/\ngen.*\n*.py\n!keep.py\n!x/deep/*.py\n")
    assert files.discover(str(tmp_path)) == ["keep.py", "x/deep/b.py"]
