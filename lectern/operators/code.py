"""A static look at generated scene code: what it imports and uses.  It prevents accidents; it is no sandbox."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that scene code may import, names and attributes that it may not use.
IMPORTS = frozenset(("manim", "math", "random", "numpy", "kit"))
NAMES = frozenset("open exec eval compile __import__ globals locals vars getattr setattr delattr input breakpoint exit quit".split())
ATTRIBUTES = NAMES | frozenset("os sys subprocess shutil pathlib socket importlib ctypes ctypeslib".split())


def _dunder(name: str) -> bool:
    return name[:2] == "__" == name[-2:] and len(name) > 4


class _Look(ast.NodeVisitor):
    def __init__(self, imports: frozenset[str]) -> None:
        self.imports = imports
        self.found: list[str] = []

    def note(self, node: ast.AST, what: str) -> None:
        self.found.append(f"{getattr(node, 'lineno', 0)}: {what}")

    def visit_Import(self, node: ast.Import) -> None:
        for name in node.names:
            first, *rest = name.name.split(".")
            if first not in self.imports or ATTRIBUTES.intersection(rest):
                self.note(node, f"import {name.name}")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.level or (node.module or "").split(".")[0] not in self.imports:
            self.note(node, f"import from {'.' * node.level}{node.module or ''}")

    def visit_Name(self, node: ast.Name) -> None:
        if node.id in NAMES or _dunder(node.id):
            self.note(node, f"name {node.id}")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if node.attr in ATTRIBUTES or _dunder(node.attr):
            self.note(node, f"attribute {node.attr}")
        self.generic_visit(node)


def problems(code: str, scene: str = "SectionScene", imports: frozenset[str] = IMPORTS) -> list[str]:
    """What is wrong with a piece of code, as ``line: what``: it doesn't parse, imports or uses what it may not, or has not just the one class."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [f"{getattr(e, 'lineno', None) or 0}: syntax"]
    look = _Look(imports)
    look.visit(tree)
    classes = [n.name for n in tree.body if isinstance(n, ast.ClassDef)]
    return look.found + ([] if classes == [scene] else [f"0: classes {', '.join(classes) or 'none'}"])


def code_problems(code: Column, scene: str = "SectionScene") -> Column:
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda c: problems(c, scene), na_action="ignore")

    return F.pandas_udf(f, "array<string>")(code)


def unfenced(text: Column) -> Column:
    """What stands inside a markdown fence, or the text where there is none."""
    t = F.btrim(text, F.lit(" \t\n\r"))
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")).otherwise(t)
