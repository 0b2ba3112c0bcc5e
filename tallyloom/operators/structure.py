"""Facts, rules and clean-up of diagram texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import text as X
from .hold import hold, hold_fields

# --- fixed values: declaration patterns -------------------------------------------------
CLASS_DECL = r"(?imd)^\s*(?:abstract\s+)?(?:class|interface|enum|annotation)\s+([A-Za-z_][\w.]*)"
OBJECT_DECL = r"(?imd)^\s*object\s+(?:\"[^\"]+\"\s+as\s+)?([A-Za-z_][\w]*)"
COMPONENT_DECL = r"(?imd)^\s*(?:\[([^\]]+)\]|(?:component|node|folder|frame|cloud|database)\s+([A-Za-z_][\w.]*))"
PACKAGE_DECL = r"(?imd)^\s*package\s+(?:\"([^\"]+)\"|([A-Za-z_][\w.]*))"
ENTITY_DECL = (
    r"(?imd)^\s*(?:abstract\s+)?(?:class|interface|enum|object|component|package|node|database|queue|cloud)\s+"
    r"[\"'\[\{]?(\w+)"
)
ENTITY_SKIP = ["as", "note", "title", "legend", "left", "right", "top", "bottom"]
EDGE = r"(\w+)\s*(?:\[)?\s*(<\|--|<\|\.\.|--\|>|\.\.\|>|\*--|o--|\.\.>|\.\.|-->|->)\s*(?:\[)?\s*(\w+)"
CONNECTOR = r"(-->|\.\.>|\*--|o--|--\|>|<\|--|\.\.\|>|\+--)"
#: a line that is neither tag, title, style nor layout, and alone as long as the least body; the search ends at the first
BODY_LINE = (
    r"(?md)^(?!\s*(?:(?i:title|skinparam)\b|left to right direction|hide\b|!theme\b))[^\n@]*?[^\s@][^\n@]{6}[^\s@]"
)
# --- fixed values: directives and style lines that are removed ------------------------------
UNSAFE = (
    r"(?i)^\s*!(?:include|includeurl|import|pragma|define|undef|definelong|enddefinelong|startsub|endsub|"
    r"function|endfunction|procedure|endprocedure|return|exit|theme|includesub)\b"
)
STYLE = r"(?i)^\s*skinparam\b|^\s*style\s+\S"
COLOUR_WORD = (
    r"(?i)\b(?:BackgroundColor|FontColor|BorderColor|ArrowColor|LineColor|Shadowing|RoundCorner|Gradient)\b"
)


def body_of(code: Column) -> Column:
    """The first block without its tags; the name functions below read this."""
    return X.once(X.bounded_block(code), X.without_tags)


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def class_names(body: Column) -> Column:
    return _all(body, CLASS_DECL)


def object_names(body: Column) -> Column:
    return _all(body, OBJECT_DECL)


def component_names(body: Column) -> Column:
    """Bracketed or keyword components, first word, odd characters underscored."""
    picked = F.zip_with(
        _all(body, COMPONENT_DECL, 1), _all(body, COMPONENT_DECL, 2), lambda a, b: F.when(a != "", a).otherwise(b)
    )
    bare = F.transform(
        picked, lambda n: F.regexp_replace(F.regexp_replace(X.strip(n), r"(?i)\s+as\s+\S+$", ""), r"^[ \"']+|[ \"']+$", "")
    )
    first = F.transform(bare, lambda n: F.regexp_replace(F.regexp_extract(n, r"^(\S*)", 1), r"[^\w.]", "_"))
    return F.filter(first, lambda n: n != "")


def package_names(body: Column) -> Column:
    picked = F.zip_with(
        _all(body, PACKAGE_DECL, 1), _all(body, PACKAGE_DECL, 2), lambda a, b: F.when(a != "", a).otherwise(b)
    )
    return F.filter(F.transform(picked, X.strip), lambda n: n != "")


def declared_names(body: Column, kind: Column) -> Column:
    """Names a diagram of this kind declares; the caller makes them distinct."""
    classes = class_names(body)
    return (
        F.when(kind == "object", F.concat(object_names(body), classes))
        .when(kind == "component", F.concat(component_names(body), classes))
        .when(kind == "package", F.concat(package_names(body), classes))
        .otherwise(classes)
    )


def entity_names(code: Column) -> Column:
    """Distinct declared entities of any kind in text order."""
    names = F.array_distinct(_all(code, ENTITY_DECL))
    return F.filter(names, lambda n: ~F.lower(n).isin(*ENTITY_SKIP))


def relation_count(code: Column) -> Column:
    """Lines that hold a connector and are neither comment nor note."""
    def is_relation(line: Column) -> Column:
        s = X.strip(line)
        hit = F.lit(False)
        for token in fixed.RELATION_TOKENS:
            hit = hit | F.contains(s, F.lit(token))
        return hit & ~s.startswith("'") & ~s.startswith("/'") & ~F.lower(s).startswith("note ")

    return F.size(F.filter(X.lines(code), is_relation))


# facts -------------------------------------------------------------------------------------

def entity_facts(diagrams: DataFrame) -> DataFrame:
    """L1: one row per declared name with its kind and place among its kind."""
    bodies = hold(diagrams, {"body": body_of(F.col("plantuml_code"))}, ["artifact_id"])
    code = F.col("body")
    kinds = [
        ("class", class_names(code)), ("object", object_names(code)),
        ("component", component_names(code)), ("package", package_names(code)),
    ]

    def facts(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n, i: F.struct(F.lit(kind).alias("kind"), n.alias("name"), i.alias("pos")))

    every = F.flatten(F.array(*[facts(k, names) for k, names in kinds]))
    return bodies.select("artifact_id", F.inline(every))


def entity_frequency(diagrams: DataFrame) -> DataFrame:
    """L1: in how many diagrams a name is declared."""
    names = diagrams.select(F.explode(entity_names(F.col("plantuml_code"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("diagrams"))


def edge_facts(diagrams: DataFrame) -> DataFrame:
    """Relationship edges between declared names, parents first for inheritance.

    Both ends are checked against the names of the same diagram inside the row; nothing is
    joined or paired, and only lines with a connector leave the row.
    """
    named = diagrams.select("artifact_id", "plantuml_code", F.array_distinct(_all(F.col("plantuml_code"), ENTITY_DECL)).alias("names"))
    return with_edges(named, "names").select("artifact_id", F.inline("edges"))


def with_edges(diagrams: DataFrame, names: str) -> DataFrame:
    """Add ``edges``, the relationship edges of ``plantuml_code`` between the ``names`` of the row, in order."""
    kept = list(diagrams.columns)
    known = hold(diagrams, {"lines": X.lines(F.coalesce("plantuml_code", F.lit(""))), "known": F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))})
    # plain searches first: the pattern only runs on lines that can hold an edge, and its groups
    # are taken from the short match
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    likely = F.filter(
        numbered,
        lambda e: (F.contains(e["line"], F.lit("-")) | F.contains(e["line"], F.lit("..")))
        & ~X.lstrip(e["line"]).startswith("'"),
    )
    found = F.transform(
        likely, lambda e: F.struct(e["line_no"].alias("line_no"), F.regexp_extract(e["line"], EDGE, 0).alias("m"))
    )
    edges = F.transform(
        F.filter(found, lambda e: e["m"] != ""),
        lambda e: F.struct(
            e["line_no"].alias("line_no"), F.regexp_extract(e["m"], EDGE, 1).alias("a"),
            F.regexp_extract(e["m"], EDGE, 2).alias("op"), F.regexp_extract(e["m"], EDGE, 3).alias("b"),
        ),
    )
    known = hold(known, {"edges": edges}, [*kept, "known"])
    # one hash pass tells the ends that are no names; only where there are such is each edge looked at
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"])))
    known = hold(known, {"strange": F.array_except(ends, F.col("known"))}, [*kept, "edges"])
    inside = F.filter("edges", lambda e: ~F.array_contains("strange", e["a"]) & ~F.array_contains("strange", e["b"]))
    edges = F.when(F.size("strange") > 0, inside).otherwise(F.col("edges"))
    def turned(e: Column) -> Column:
        down, up = e["op"].isin("<|--", "<|.."), e["op"].isin("--|>", "..|>")
        return F.struct(
            e["line_no"].alias("line_no"), e["op"].alias("op"),
            F.when(up, e["b"]).otherwise(e["a"]).alias("src"),
            F.when(up, e["a"]).otherwise(e["b"]).alias("dst"),
            F.when(down | up, F.lit("inherit")).otherwise(F.lit("assoc")).alias("kind"),
        )

    return hold(known, {"edges": F.transform(edges, turned)}, kept)


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Edges that leave and reach every entity of every diagram, by (artifact_id, name).

    Both ends of an edge are counted where they are found and only the counts travel, so a hub
    that a third of all edges touch arrives as one row per task.
    """
    ends = edges.select(
        "artifact_id",
        F.inline(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))),
    )
    return ends.groupBy("artifact_id", "name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hubs(degrees: DataFrame) -> DataFrame:
    """Degree of every name over all diagrams."""
    return degrees.groupBy("name").agg(
        F.count("*").alias("diagrams"), F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"),
        F.max(F.col("out_degree") + F.col("in_degree")).alias("most_in_a_diagram"),
    )


def centres(degrees: DataFrame) -> DataFrame:
    """The entity each diagram turns on: most edges, ties to the first name."""
    degree = F.col("out_degree") + F.col("in_degree")
    best = F.min(F.struct((-degree).alias("d"), F.col("name").alias("name")))
    return degrees.groupBy("artifact_id").agg(best.alias("b"), F.count("*").alias("entities")).select(
        "artifact_id", F.col("b.name").alias("centre"), (-F.col("b.d")).alias("degree"), "entities"
    )


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges per operator and kind, with the diagrams they occur in."""
    per = edges.groupBy("op", "kind", "artifact_id").agg(F.count("*").alias("n"))
    return per.groupBy("op", "kind").agg(F.sum("n").alias("edges"), F.count("*").alias("diagrams"))


# types -------------------------------------------------------------------------------------

def inferred_type(code: Column) -> Column:
    """L2: ordered rules over the lower-case text."""
    c = F.lower(F.coalesce(code, F.lit("")))

    def says(*words: str) -> Column:
        out = F.contains(c, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(c, F.lit(w))
        return out

    def found(p: str) -> Column:
        return F.rlike(c, F.lit("(?md)" + p))

    # the last of the flow signs counts only in a text without classes
    flow = found(r"^\s*start\s*$") | found(r"^\s*stop\s*$") | says("if (") | found(r"^\s*:[^;]+;")
    return (
        F.when(says("usecase") | found(r"\bactor\s+"), "usecase")
        .when(found(r"\bobject\s+\w+") | says('object "'), "object")
        .when(says("package ", 'package "'), "package")
        .when(found(r"\bcomponent\s+") | found(r"\[.+\]\s+as\s+"), "component")
        .when(says("[*]") | found(r"\bstate\s+"), "state")
        .when(found(r"\bnode\s+") | says("cloud "), "deployment")
        .when(says("participant "), "sequence")
        .when(flow & ~says("class "), "flowchart")
        .when(says("class ", "abstract ", "interface ", "enum "), "class")
        .otherwise("unknown")
    )


def type_census(diagrams: DataFrame) -> DataFrame:
    """L2: declared against inferred type."""
    return diagrams.groupBy("diagram_type", inferred_type(F.col("plantuml_code")).alias("inferred")).agg(
        F.count("*").alias("n")
    )


# rules -------------------------------------------------------------------------------------

def _messages(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(m)) for m, test in rules]))


def _found(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _named(names: Column, none: str, repeated: str) -> Column:
    """Messages ``none`` without names and ``repeated`` with more names than distinct names, case aside."""
    return X.once(
        names,
        lambda n: _messages([(none, F.size(n) == 0), (repeated, F.size(n) != F.size(F.array_distinct(F.transform(n, F.lower))))]),
    )


def syntax_messages(code: Column) -> Column:
    """L3: the basic syntax rules."""
    low = F.lower(code)
    opened = (F.octet_length(low) - F.octet_length(F.replace(low, F.lit("@startuml"), F.lit("")))) / len("@startuml")
    body = F.regexp_replace(code, r"(?imd)@startuml|@enduml|^\s*title\b[^\n]*$|^\s*skinparam\b[^\n]*$", "")
    body = F.regexp_replace(body, r"(?md)^\s*(left to right direction|hide\b.*|!theme\b.*)$", "")
    short = F.when(_found(code, BODY_LINE), F.lit(False)).otherwise(F.length(X.strip(body)) < 8)
    return _messages(
        [
            ("Missing @startuml", ~X.has_open_tag(code)),
            ("Missing @enduml", ~X.has_close_tag(code)),
            ("Multiple @startuml blocks", ~X.one_block(code) & (opened > 1)),
            ("Unbalanced curly braces", X.count_char(code, "{") != X.count_char(code, "}")),
            ("Diagram body is empty or incomplete", short),
            (
                "Invalid worded relationship arrow (use --|>, -->, *--, o--, ..>)",
                _found(code, r"--\s*[A-Za-z_]{3,}\s*-->"),
            ),
        ]
    )


def package_messages(code: Column) -> Column:
    """L4: the package rules."""
    body = X.strip(F.regexp_replace(code, r"(?imd)@startuml|@enduml|^\s*title\b[^\n]*$", ""))
    block = _found(code, r"(?imd)^\s*package\s+\S[^\n{]*\{")
    inner = X.without_tags(code)
    filled = _found(inner, r"(?imd)^\s*(class|interface|component|package)\s+\w+") | _found(inner, r"\.\.>|->|-->|\+--")
    dotted = F.size(_all(code, r"package\s+([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+)"))
    tops = _all(code, r"(?md)^package\s+(\w+)")
    by_line = F.flatten(
        F.transform(
            X.lines(code),
            lambda line: F.array_compact(
                F.array(
                    F.when(
                        F.contains(line, F.lit(">")) & _found(line, r"^\s*([A-Za-z_][\w.]*)\s+(\.\.>|->|-->)\s*\1\b"),
                        F.concat(F.lit("Self-referential dependency: "), X.strip(line)),
                    )
                )
            ),
        )
    )
    contained = F.transform(
        F.filter(X.lines(code), lambda line: F.contains(line, F.lit("+--")) & _found(line, r"^\s*(\w+)\s+\+--\s*\1\b")),
        lambda line: F.concat(F.lit("Invalid self-containment: "), X.strip(line)),
    )
    return F.concat(
        _messages(
            [
                ("Package diagram appears empty or incomplete", F.length(body) < 12),
                ("Package diagram has no package { } declarations", ~_found(code, r"(?imd)^\s*package\s+")),
                ("Package diagram needs package Name { ... } blocks, not bare package lines", ~block),
                ("Package blocks are empty (no nested types or dependencies)", block & ~filled),
            ]
        ),
        by_line,
        _messages(
            [
                (
                    "Multiple dotted package names without nesting; prefer nested package { } for containment",
                    (dotted >= 2) & ~_found(code, r"package\s+\w+\s*\{"),
                ),
                (
                    "Duplicate package names at declaration sites",
                    F.size(tops) != F.size(F.array_distinct(tops)),
                ),
            ]
        ),
        contained,
    )


def object_messages(code: Column) -> Column:
    """L4: the object rules."""
    typed = _found(code, r"(?imd)^\s*object\s+\w+\s*:\s*\w+")
    labelled = _found(code, r'(?imd)^\s*object\s+"[^"]+\s*:\s*[^"]+"\s+as\s+\w+')
    bare = F.regexp_extract(code, r"(?imd)^\s*object\s+(\w+)\s*\{", 1)
    return F.concat(
        _messages(
            [
                (
                    "Object instances should use name:Type syntax (e.g. object cart1 : Cart)",
                    _found(code, r"(?imd)^\s*object\s+") & ~typed & ~labelled,
                )
            ]
        ),
        F.when(
            bare != "", F.array(F.concat(F.lit("Object '"), bare, F.lit("' is missing :Type before attribute block")))
        ).otherwise(F.array().cast("array<string>")),
    )


def component_messages(code: Column) -> Column:
    return _messages([("Empty component interface notation", _found(code, r"(?md)\(\)\s*$"))])


def flowchart_messages(code: Column) -> Column:
    """L4: the flowchart rules."""
    def signs(body: Column) -> Column:
        return F.struct(
            _found(body, r"(?md)^\s*:[^;\n]+;").alias("step"), _found(body, r"(?imd)^\s*start\s*$").alias("start"),
            _found(body, r"(?imd)^\s*(stop|end)\s*$").alias("stop"), F.contains(F.lower(body), F.lit("endif")).alias("endif"),
            (_found(body, r"(?md)^\s*class\s+\w+") | _found(body, r"(?md)^\s*object\s+\w+")).alias("shapes"),
            # the pattern is for lines that have an arrow
            (F.contains(body, F.lit("-->")) & _found(body, r"(?md)^\s*:\w+.*-->\s*\w+")).alias("arrow"),
        )

    def messages(s: Column) -> Column:
        active = s["start"] | s["step"] | s["stop"] | s["endif"]
        return _messages(
            [
                (
                    "Flowchart looks like a structural UML diagram; use activity syntax (start / :Step; / if / stop)",
                    s["shapes"] & ~active,
                ),
                ("Flowchart has no activity steps (:Step;) or start", ~s["step"] & ~s["start"]),
                ("Flowchart has start but missing stop/end", s["start"] & ~s["stop"]),
                ("Flowchart steps should not use class-style --> arrows", active & s["arrow"]),
            ]
        )

    return X.once(X.once(X.without_tags(code), signs), messages)


def structure_messages(body: Column, kind: Column) -> Column:
    """L4: what a diagram of its kind must declare; reads the text without its tags."""
    objects, packages = object_names(body), package_names(body)
    of_class = F.concat(
        _named(class_names(body), "Class diagram has no class/interface/enum declarations", "Duplicate class declarations"),
        _messages([("Unsupported worded relationship arrow", _found(body, r"--\s*[A-Za-z]+\s*-->"))]),
    )
    of_component = _named(component_names(body), "Component diagram has no components", "Duplicate component names")
    of_package = _messages(
        [
            ("Package diagram has no package declarations", F.size(packages) == 0),
            ("Package diagram needs nested package { } blocks", ~_found(body, r"(?i)package\s+.+\s*\{")),
        ]
    )
    return (
        F.when(kind == "class", of_class)
        .when(kind == "object", _messages([("Object diagram has no object instances", F.size(objects) == 0)]))
        .when(kind == "component", of_component)
        .when(kind == "package", of_package)
        .when(kind == "sequence", F.array(F.lit("Sequence diagrams are not a supported generation type in this pipeline")))
        .otherwise(F.array().cast("array<string>"))
    )


def type_messages(code: Column, kind: Column) -> Column:
    """L4: rules of the diagram's own kind."""
    return (
        F.when(kind == "package", package_messages(code))
        .when(kind == "object", object_messages(code))
        .when(kind == "component", component_messages(code))
        .when(kind == "flowchart", flowchart_messages(code))
        .otherwise(F.array().cast("array<string>"))
    )


def checked(diagrams: DataFrame) -> DataFrame:
    """L3/L4: the block and the messages of every rule set, each computed once."""
    kept = [c for c in diagrams.columns if c not in ("block", "body")]
    block = X.bounded_block(F.col("plantuml_code"))
    bodies = hold_fields(diagrams, X.once(block, lambda b: F.struct(b.alias("block"), X.without_tags(b).alias("body"))), kept)
    return hold(
        bodies,
        {
            "syntax": syntax_messages(F.col("block")),
            "typed": type_messages(F.col("block"), F.col("diagram_type")),
            "rules": structure_messages(F.col("body"), F.col("diagram_type")),
        },
    )


def rule_counts(diagrams: DataFrame, messages: Column) -> DataFrame:
    """Failing rows per rule; the line quoted after a colon is left out of the rule's name."""
    rows = diagrams.select("diagram_type", F.explode(messages).alias("message"))
    rule = F.regexp_replace(F.regexp_replace("message", r"(?<=dependency|containment): .*$", ""), r"'\w+'", "''")
    return rows.groupBy("diagram_type", rule.alias("rule")).agg(F.count("*").alias("n"))


# clean-up ----------------------------------------------------------------------------------

def _rewrite(line: Column) -> Column:
    """Worded arrows become connectors; stray semicolons go."""
    raw = X.rstrip(line)
    decl = r"(?i)^(\s*(?:class|interface|enum|abstract\s+class)\s+\S+)\s*;\s*$"
    word = r"^(\s*)([A-Za-z_][\w.]*)\s+--\s*([A-Za-z_]+)\s*-->\s*([A-Za-z_][\w.]*)\s*;?\s*$"
    arrow = (
        r"^(\s*)([A-Za-z_][\w.]*)\s+((?:<\|--|--\|>|\*--|o--|\.\.\|>|\.\.>|-->|\+--))\s*([A-Za-z_][\w.]*)\s*;\s*$"
    )
    arrows = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.ARROW_WORDS.items()))
    sign = F.coalesce(F.try_element_at(arrows, F.lower(F.regexp_extract(raw, word, 3))), F.lit("-->"))
    lead = X.lstrip(raw)
    control = _found(lead, r"^(:|if |else|endif|stop|start|fork|again)")
    member = (
        raw.endswith(";") & ~F.contains(raw, F.lit("--")) & ~F.contains(raw, F.lit("..")) & ~lead.startswith("@")
        & _found(raw, r"^\s*[+\-#~]?[\w].*[:\(]")
    )
    return (
        F.when(~F.contains(raw, F.lit(";")) & ~F.contains(raw, F.lit("--")), raw)  # nothing below applies
        .when(_found(raw, decl), F.regexp_replace(raw, decl, "$1"))
        .when(
            _found(raw, word),
            F.concat(
                F.regexp_extract(raw, word, 1), F.regexp_extract(raw, word, 2), F.lit(" "), sign, F.lit(" "),
                F.regexp_extract(raw, word, 4),
            ),
        )
        .when(_found(raw, arrow), F.regexp_replace(raw, arrow, "$1$2 $3 $4"))
        .when(control, raw)
        .when(member, X.rstrip(F.regexp_replace(raw, ";$", "")))
        .otherwise(raw)
    )


def keyed_lines(lines: Column) -> Column:
    """Lines sorted by key and place; lines that may repeat get their place as key.

    Blank lines, tags and closers may repeat. Sorted, a repeat stands right behind its first
    occurrence: one sort inside the row instead of a search per line, and no shuffle of text.
    """
    def key(line: Column, i: Column) -> Column:
        s = X.strip(line)
        own = (s == "") | s.startswith("@") | s.endswith("}")
        return F.struct(
            F.when(own, F.concat(F.lit("\u0001"), i.cast("string"))).otherwise(s).alias("key"),
            i.alias("i"), line.alias("line"),
        )

    return F.sort_array(F.transform(lines, key))  # array_sort would run a lambda per comparison


def unrepeated(ordered: Column) -> Column:
    """The first line of every key of :func:`keyed_lines`, in text order."""
    none = F.array(F.lit(None).cast("struct<key:string,i:int,line:string>"))
    marked = F.zip_with(
        ordered, F.concat(none, ordered),
        lambda x, before: F.struct(
            x["i"].alias("i"), x["line"].alias("line"),
            (x["i"].isNotNull() & (before["key"].isNull() | (before["key"] != x["key"]))).alias("first"),
        ),
    )
    return F.transform(F.sort_array(F.filter(marked, lambda x: x["first"])), lambda x: x["line"])


def is_unsafe(line: Column) -> Column:
    return _found(line, UNSAFE)


def is_style(line: Column) -> Column:
    return _found(line, STYLE) | _found(line, COLOUR_WORD)


def without_colours(lines: Column) -> Column:
    """No style lines, no inline colours, no blank lines."""
    kept = F.filter(lines, lambda x: ~is_unsafe(x) & ~is_style(x))
    bare = F.transform(
        kept,
        lambda x: X.rstrip(
            F.regexp_replace(F.regexp_replace(x, r"#[0-9A-Fa-f]{3,8}\b", ""), r"\s+#[A-Za-z][\w]*", "")
        ),
    )
    return F.filter(bare, lambda x: X.strip(x) != "")


def _balanced(code: Column, lines: Column) -> Column:
    """Missing closers go before the end tag; surplus closer lines go from the end."""
    extra = X.count_char(code, "{") - X.count_char(code, "}")
    closed = F.replace(
        code, F.lit("@enduml"), F.concat(F.repeat(F.lit("}"), F.greatest(extra, F.lit(0))), F.lit("\n@enduml"))
    )
    closers = F.filter(F.transform(lines, lambda x, i: F.when(X.strip(x) == "}", i)), lambda i: i.isNotNull())
    dropped = F.slice(F.reverse(closers), F.lit(1), F.greatest(-extra, F.lit(0)))
    trimmed = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(dropped, i)), "\n")
    return F.when(extra > 0, closed).when(extra < 0, trimmed).otherwise(code)


def cleaned(diagrams: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Safe, uncoloured, repeat-free text with the publication header.

    ``max_lines`` cuts runaway output; ``None`` keeps every line. Each step is held, so a text
    passes each pattern once, and all steps run in one stage without a shuffle.
    """
    name = "plantuml_code"
    block = F.regexp_replace(X.bounded_block(F.col(name)), r"(?imd)^@(?:startchen|endchen)\b.*$", "")
    out = hold(diagrams, {"__lines": X.lines(block)}, [c for c in diagrams.columns if c != name])
    out = hold(out, {"__lines": F.transform("__lines", _rewrite)})
    safe = F.transform(
        F.filter("__lines", lambda x: ~is_unsafe(x)),
        lambda x: F.regexp_replace(x, r"(?i)!(?:include|includeurl|import)\b[^\n]*", ""),
    )
    out = hold(out, {"__lines": F.filter(safe, lambda x, i: (i == 0) | ~F.lower(X.strip(x)).startswith("@startuml"))})
    out = hold(out, {"__lines": keyed_lines(F.col("__lines"))})
    out = hold(out, {"__lines": unrepeated(F.col("__lines"))})
    if max_lines is not None:
        cut = F.concat(F.slice("__lines", 1, max_lines), F.array(F.lit("@enduml")))
        out = hold(out, {"__lines": F.when(F.size("__lines") > max_lines, cut).otherwise(F.col("__lines"))})
    out = hold(out, {"__lines": F.col("__lines"), "__text": F.array_join("__lines", "\n")})
    out = hold(out, {"__text": _balanced(F.col("__text"), F.col("__lines"))}).drop("__lines")
    header = "\n".join(fixed.PUBLICATION_STYLE)
    bare = F.array_join(without_colours(X.lines(F.col("__text"))), "\n")
    return hold(out, {name: F.regexp_replace(bare, r"(?i)^(@startuml[^\n]*)", "$1\n" + header)}).drop("__text")


def cleaning_counts(diagrams: DataFrame) -> DataFrame:
    """What the clean-up takes out or rewrites, by kind."""
    worded = r"^\s*[A-Za-z_][\w.]*\s+--\s*[A-Za-z_]+\s*-->\s*[A-Za-z_][\w.]*\s*;?\s*$"
    split = hold(diagrams, {"lines": X.lines(X.bounded_block(F.col("plantuml_code")))}, [])
    keys = F.array_distinct(F.transform(keyed_lines(F.col("lines")), lambda x: x["key"]))
    per = split.select(
        F.size(F.filter("lines", is_unsafe)).alias("unsafe"),
        F.size(F.filter("lines", is_style)).alias("style"),
        F.size(F.filter("lines", lambda x: _found(x, worded))).alias("worded_arrow"),
        (F.size("lines") - F.size(keys)).alias("repeated"),
    )
    names = ["unsafe", "style", "worded_arrow", "repeated"]
    stacked = per.unpivot([], names, "rule", "n")
    return stacked.groupBy("rule").agg(F.sum("n").alias("lines"), F.count_if(F.col("n") > 0).alias("diagrams"))


def needs_fallback(code: Column, entities: Column, valid: Column, most: int | None = None) -> Column:
    """Validation failed, only generic class names, or none of the (first ``most``) specified entities in the text."""
    entities = entities if most is None else F.slice(entities, 1, most)
    names = F.transform(_all(code, r"(?imd)^\s*class\s+(\w+)"), F.lower)
    generic = (F.size(names) > 0) & F.forall(names, lambda n: n.isin(*fixed.GENERIC_CLASS_NAMES))
    low = F.lower(code)
    absent = (F.size(entities) > 0) & ~F.exists(entities, lambda e: F.contains(low, F.lower(e)))
    return ~F.coalesce(valid, F.lit(False)) | generic | absent
