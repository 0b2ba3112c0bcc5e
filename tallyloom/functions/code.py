"""Source-code signals as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .. import fixed
from . import text as X

# --- fixed values: patterns that mark a text as source code; two must be found -----------
CODE_SIGNALS = [
    r"\b(class|def|function|interface|struct|enum|public|private|package|import|typedef)\b",
    r"[{};]\s*$",
    r"^\s{2,}\w+",
    r"->|=>|::",
    r"\(\s*self\s*[,)]",
    r"\bprint\s*\(",
    r"\binput\s*\(",
    r"^\s*#",
    r"^\s*#\s*include\b",
]
PYTHON_SIGNALS = [
    r"^\s*#", r"\bprint\s*\(", r"\binput\s*\(", r"\belif\b", r"\b(True|False|None)\b",
    r"\bimport\s+\w", r"\bfrom\s+\w+\s+import", r"\bint\s*\(", r"\bfloat\s*\(", r"\bstr\s*\(",
]

#: what a text with the signal holds in any case
SIGNAL_NEEDS = {
    r"\b(class|def|function|interface|struct|enum|public|private|package|import|typedef)\b": ["class|def|function|interface|struct|enum|public|private|package|import"],
    r"[{};]\s*$": ["{|}|;"], r"->|=>|::": ["->|=>|::"], r"\(\s*self\s*[,)]": ["self", "("], r"\bprint\s*\(": ["print", "("],
    r"\binput\s*\(": ["input", "("], r"^\s*#": ["#"], r"^\s*#\s*include\b": ["include", "#"], r"\belif\b": ["elif"],
    r"\b(True|False|None)\b": ["True|False|None"], r"\bimport\s+\w": ["import"], r"\bfrom\s+\w+\s+import": ["from", "import"],
    r"\bint\s*\(": ["int", "("], r"\bfloat\s*\(": ["float", "("], r"\bstr\s*\(": ["str", "("],
}


def found(c: Column, pattern: str, *needs: str) -> Column:
    """Does a line-anchored pattern occur? Only a newline ends a line.

    ``needs`` are texts any match holds, alternatives with a bar between; where one is missing
    the pattern, many times as slow as a plain search, does not run.
    """
    out = F.rlike(c, F.lit("(?md)" + pattern))
    for need in reversed(needs):
        one, *others = need.split("|")
        there = F.contains(c, F.lit(one))
        for other in others:
            there = there | F.contains(c, F.lit(other))
        out = there & out
    return out


def has(c: Column, *words: str) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out & F.contains(c, F.lit(w))
    return out


def signal_count(c: Column, patterns: list[str]) -> Column:
    return sum((found(c, p, *SIGNAL_NEEDS.get(p, [])).cast("int") for p in patterns), F.lit(0))


def looks_like_code(c: Column) -> Column:
    """At least two signals in the stripped text."""
    s = X.strip(F.coalesce(c, F.lit("")))
    return (F.length(s) >= 8) & (signal_count(s, CODE_SIGNALS) >= 2)


def resolve_mode(text: Column, mode: Column) -> Column:
    """A requirement that is really source code changes its mode."""
    return F.when((mode == "requirement") & looks_like_code(text), F.lit("source_code")).otherwise(mode)


def language(c: Column) -> Column:
    """Ordered language rules; the first that applies names the language."""
    public_base = found(c, r"class\s+\w+\s*:\s*public", "public", "class", ":")
    c_like = found(c, r"^\s*#\s*include\s*[<\"]", "#", "include") | found(c, r"\btypedef\s+struct\b", "typedef", "struct")
    script = r"\b(function|const|let|var|export\s+class|interface)\b"
    rules = [
        (c_like & (found(c, r"\bstd::|namespace\s+\w+", "std::|namespace") | public_base), "cpp"),
        (c_like, "c"),
        (found(c, r"\b(public|private|protected)\s+(class|interface|enum)\s+\w+", "public|private|protected", "class|interface|enum"), "java"),
        (found(c, r"^\s*import\s+[\w.*]+\s*;\s*$|^\s*package\s+[\w.]+\s*;\s*$", ";", "import|package"), "java"),
        (found(c, r"^\s*(public\s+)?class\s+\w+\s*\{", "{", "class") & found(c, r"\b(boolean|void|String|int|double|float|long)\b", "boolean|void|String|int|double|float|long"), "java"),
        (found(c, r"^\s*def\s+\w+", "def"), "python"),
        (found(c, r"^\s*class\s+\w+[^:{]*:", ":", "class"), "python"),
        (signal_count(c, PYTHON_SIGNALS) >= 2, "python"),
        (found(c, script, "function|const|let|var|export|interface") & has(c, ":", "=>"), "typescript"),
        (found(c, script, "function|const|let|var|export|interface"), "javascript"),
        (has(c, "fn ") & (has(c, "impl ") | has(c, "struct ")), "rust"),
        (
            (found(c, r"^\s*package\s+\w+|func\s+\(\w+\s+\*", "package|func") | (has(c, "func ") & has(F.replace(c, F.lit(" "), F.lit("")), "struct{")))
            & has(c, "func ", "package "),
            "go",
        ),
        (has(c, "namespace ") & found(c, r"\bpublic\s+class\b"), "csharp"),
        (has(c, "class ") & found(c, r"\b(fun |open class |val |var )\b", "fun |class |val |var "), "kotlin"),
        (has(c, "->") & found(c, r"\b(func |var |let |class )\b", "func |var |let |class "), "swift"),
        (
            (has(c, "public:") | has(c, "std::") | has(c, "};")) & (has(c, "public:") | public_base)
            & found(c, r"\bclass\s+\w+\s*(:|\{)|#include\b", "class|#include"),
            "cpp",
        ),
        (has(c, "class ") & found(c, r"\b(attr_accessor|def\s+\w+|end\b)", "attr_accessor|def|end"), "ruby"),
        (has(c, "<?php") | (has(c, "class ", "$") & found(c, r"\bfunction\s+\w+\s*\(.*\)\s*\{", "function")), "php"),
        (has(c, "class ", ":") & found(c, r"\b(def |extends |val )\b", "def |extends |val "), "scala"),
        (has(c, "class ", "=>", ";"), "dart"),
        (has(c, "defmodule ") | has(c, "do:"), "elixir"),
        (found(c, r"\bdata\s+\w+\s*=", "data", "=") | has(c, "::", "->"), "haskell"),
        (has(c, "setRefClass") | has(c, "<-", "function("), "r"),
        (has(c, "classdef "), "matlab"),
        (has(c, "package ", "bless"), "perl"),
        (has(c, "function ", "end", "setmetatable"), "lua"),
    ]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, name in rules[1:]:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def type_names(c: Column) -> Column:
    """Declared type names in any of the brace, colon or struct spellings."""
    declared = F.regexp_extract_all(c, F.lit(r"\b(?:class|interface|enum|struct)\s+(\w+)"), F.lit(1))
    return F.array_distinct(declared)


def normal_language(c: Column) -> Column:
    """One spelling per language; an unlisted name is underscored."""
    key = F.lower(X.strip(c))
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.LANGUAGE_NAMES.items()))
    other = F.nullif(F.replace(key, F.lit(" "), F.lit("_")), F.lit(""))
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(F.try_element_at(names, key), other))
