"""Plain models of the rules, for comparison on random inputs."""

from __future__ import annotations

import random


def one_line(text: str, width: int = 160) -> str:
    text = text.strip()
    marks = len(text) - len(text.lstrip("#"))
    if 1 <= marks <= 6 and text[marks : marks + 1].isspace():
        title = text[marks:].lstrip().split("\n", 1)[0]
        if title:
            return title
    for at, (here, after) in enumerate(zip(text, text[1:])):
        if at >= width:
            break
        if here in ".!?" and after.isspace():
            return text[: at + 1]
    return text if len(text) <= width else text[:width] + "…"


def mostly_control(data: bytes | None) -> bool:
    if data is None:
        return True
    head = data[:1024]
    bad = [b for b in head if b in range(0, 9) or b in range(14, 32)]
    return bool(head) and len(bad) / len(head) > 0.30


def text_of(data: bytes | None, limit: int | None = None) -> str:
    if data is None:
        return ""
    try:
        return data[:limit].decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n")


def tree(project: str, files: list[tuple[int, str]]) -> str:
    """Recursive rendering: children in the order their first file comes up."""
    ordered = sorted(files, key=lambda f: (f[1].count("/"), f[1].rpartition("/")[2], f[0]))
    top: dict = {}
    for _, path in ordered:
        here = top
        for part in path.split("/"):
            here = here.setdefault(part, {})
    lines = [f"{project}/"]

    def draw(children: dict, lead: str):
        for i, (name, below) in enumerate(children.items()):
            final = i == len(children) - 1
            lines.append(lead + ("└── " if final else "├── ") + name + ("/" if below else ""))
            draw(below, lead + ("    " if final else "│   "))

    draw(top, "")
    return "\n".join(lines)


def flat_tree(project: str, files: list[tuple[int, str]]) -> str:
    ordered = sorted(files, key=lambda f: (f[1].count("/"), f[1].rpartition("/")[2], f[0]))
    return "\n".join([f"{project}/"] + ["  " * p.count("/") + p.rpartition("/")[2] for _, p in ordered])


def grouped_tree(project: str, files: list[tuple[int, str]]) -> str:
    groups: dict[str, list[str]] = {}
    for parts in sorted(p.split("/") for _, p in files):
        groups.setdefault("/".join(parts[:-1]), []).append("  " * (len(parts) - 1) + parts[-1])
    return "\n".join([f"{project}/"] + [line for group in groups.values() for line in group])


STACKS = [
    ("Python package", ("setup.py", "pyproject.toml")),
    ("Node.js project", ("package.json",)),
    ("Containerized service", ("dockerfile",)),
    ("Go module", ("go.mod",)),
    ("Java Maven project", ("pom.xml",)),
]


def overview(rows: list[dict]) -> str:
    """Paragraph for results given in analysis order."""
    names = [r["rel_path"].lower() for r in rows]
    tally: dict[str, int] = {}
    for r in rows:
        tally[r["kind"]] = tally.get(r["kind"], 0) + 1
    top, count = max(tally.items(), key=lambda kv: kv[1]) if tally else ("unknown", 0)
    found = [label for label, ends in STACKS if any(n.endswith(ends) for n in names)]
    readme = [r["summary"] for r, n in zip(rows, names) if n.startswith("readme") and r["kind"].startswith("text")]
    said = [readme[0].rstrip(".") + "."] if readme else []
    said.append(f"The dominant file type is *{top}* (count: {count}).")
    said.append(f"Inferred tech stack: {found[0] if found else 'Unknown or mixed\u2010language project'}.")
    for label, sentence in (
        ("Containerized service", "Presence of a Dockerfile suggests containerized deployment."),
        ("Python package", "Packaging metadata indicates a Python package."),
        ("Node.js project", "Including 'package.json' reveals a Node.js component."),
    ):
        if label in found:
            said.append(sentence)
    text = " ".join(said)
    return text if len(text) <= 300 else text[:299].rstrip() + "…"


def random_paths(rng: random.Random, n: int) -> list[str]:
    """Distinct file paths; directory names never equal file names."""
    found: dict[str, None] = {}
    while len(found) < n:
        dirs = [rng.choice(["src", "docs", "lib", "Z", "a_b", "é"]) for _ in range(rng.randrange(4))]
        found["/".join([*dirs, f"{rng.choice('abXé')}{rng.randrange(n)}{rng.choice(['.py', '.md', ''])}"])] = None
    return list(found)
