"""The command-line packer: raw directory -> pruned, selected, rendered, exported bytes."""

import os


def test_cli_packs_a_directory(spark, tmp_path, capsys):
    from sheaf.__main__ import main
    root = tmp_path / "demo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "src" / "main.rs").write_text("fn main() {}\n")
    (root / "README.md").write_text("# demo")
    (root / "node_modules" / "x" / "a.js").write_text("x")
    (root / "src" / "bad.txt").write_bytes(b"\xffA")
    out = tmp_path / "out"
    main([str(root), "--out", str(out)])
    d = out / "root_id=demo"
    doc = "".join((d / n).read_text(encoding="utf-8") for n in sorted(os.listdir(d)) if n.startswith("part-"))
    assert doc == ("# Codebase Export\n\n## Directory Structure\n\n```\n"
                   "└── 📁 demo\n    ├── 📁 src\n    │   ├── 📄 bad.txt\n    │   └── 📄 main.rs\n"
                   "    └── 📄 README.md\n```\n\n## Files\n\n"
                   "### src/main.rs\n\n```rust\nfn main() {}\n```\n\n"
                   "### README.md\n\n```markdown\n# demo\n```\n\n")
    printed = capsys.readouterr().out
    assert "Warning: Failed to read 1 file(s): " in printed and "src/bad.txt: Failed to read file" in printed
