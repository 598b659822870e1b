"""Equation scripts to LaTeX.

The grammar nests without bound, so this is a vectorised Python function; it
reads the tokens of a script with a cursor and returns LaTeX bottom-up.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are commands of the same name.
SAME = (
    "times div cdot cdots ldots vdots ddots pm mp approx equiv therefore because rightarrow leftarrow Rightarrow "
    "Leftarrow uparrow downarrow partial nabla forall exists in notin subset supset subseteq supseteq cap cup emptyset "
    "lfloor rfloor lceil rceil langle rangle log sin cos tan exp alpha beta gamma delta epsilon varepsilon zeta eta theta "
    "vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega"
).split()
#: Capital Greek letters are written in capitals.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
#: Words and signs with a command of another name.
OTHER = {"leq": r"\le", "geq": r"\ge", "neq": r"\ne", "<=": r"\le", ">=": r"\ge", "!=": r"\ne", "inf": r"\infty", "mod": r"\bmod", "prime": "'"}
WORDS = {w: f"\\{w}" for w in SAME} | {w.upper(): f"\\{w.capitalize()}" for w in GREEK} | OTHER
#: Words whose bounds follow, accents, and words that shape what stands around them.
BOUNDED = {w: f"\\{w}" for w in ("sum", "int", "prod", "lim")}
ACCENTS = {"vec": r"\vec", "hat": r"\hat", "bar": r"\overline", "dot": r"\dot", "tilde": r"\tilde"}
STRUCTURAL = {"over", "sqrt", "from", "to", "left", "right", "matrix", "cases", *BOUNDED, *ACCENTS}

_TOKEN = re.compile(r"[{}_^]|##|#|<=|>=|!=|[A-Za-z]+|[^\s]")


class _Reader:
    def __init__(self, script: str) -> None:
        self.tokens, self.at = _TOKEN.findall(script), 0

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, token: str) -> bool:
        if self.next() == token:
            self.at += 1
            return True
        return False

    def sequence(self, *ends: str) -> str:
        """Terms up to one of the ends, with a space where two words would merge."""
        out = ""
        while self.next() and self.next() not in ends:
            term = self.term()
            apart = term and out and out[-1].isascii() and out[-1].isalnum() and term[0].isascii() and term[0].isalnum()
            out += (" " if apart else "") + term
        return out

    def braced(self) -> str:
        inner = self.sequence("}")
        self.skip("}")
        return inner

    def argument(self) -> str:
        return self.braced() if self.skip("{") else self.atom()

    def atom(self) -> str:
        if not self.next():
            return ""
        token = self.take()
        if token == "{":
            return "{" + self.braced() + "}"
        return "" if token in ("}", "_", "^", "#", "##") else WORDS.get(token, token)

    def grid(self, name: str, between: str) -> str:
        """An environment of rows; a single hash parts cells."""
        if not self.skip("{"):
            return ""
        rows: list[list[str]] = [[]]
        while self.next() and self.next() != "}":
            if self.skip("##"):
                rows.append([])
            elif not self.skip("#"):
                rows[-1].append(self.sequence("}", "#", "##"))
        self.skip("}")
        lines = [between.join(r) for r in rows] if name == "pmatrix" else [c for r in rows for c in r]
        return f"\\begin{{{name}}}" + r" \\ ".join(lines) + f"\\end{{{name}}}"

    def primary(self) -> str:
        token = self.next()
        if token not in STRUCTURAL:
            return self.atom()
        self.at += 1
        if token == "sqrt":
            return f"\\sqrt{{{self.argument()}}}"
        if token in ACCENTS:
            return f"{ACCENTS[token]}{{{self.argument()}}}"
        if token in BOUNDED:
            below = f"_{{{self.argument()}}}" if self.skip("from") else ""
            return BOUNDED[token] + below + (f"^{{{self.argument()}}}" if self.skip("to") else "")
        if token in ("left", "right"):
            return f"\\{token}{self.atom()}"
        if token == "matrix":
            return self.grid("pmatrix", " & ")
        return self.grid("cases", "") if token == "cases" else token

    def term(self) -> str:
        base = self.primary()
        if self.skip("over"):
            return f"\\frac{{{_bare(base)}}}{{{_bare(self.term())}}}"
        while self.next() in ("_", "^") and self.next():
            base += f"{self.take()}{{{self.argument()}}}"
        return base


def _bare(s: str) -> str:
    """Without one pair of braces around the whole."""
    if not (s.startswith("{") and s.endswith("}") and len(s) > 1):
        return s
    depth = 0
    for c in s[1:-1]:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return s
    return s if depth else s[1:-1]


def to_latex(script: str) -> str:
    return f"${_Reader(script).sequence()}$"


def latex(script: Column) -> Column:
    """LaTeX of a script column; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else to_latex(s))

    return run(script)
