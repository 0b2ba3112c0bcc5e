"""Types, bases, methods, functions, imports, variables and steps of source texts, as facts and as a spec text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import code as CD, text as X
from .hold import hold

# --- fixed values: declaration patterns per language family, and names they do not name ----
PYTHON_TYPE = r"(?md)^\s*class\s+(\w+)(?:\s*\(([^)]*)\))?:"
PYTHON_FUNCTION = r"(?md)^\s*def\s+(\w+)\s*\("
BRACED_TYPE = r"\b(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?"
KEYWORD_FUNCTION = r"\b(?:function|func|fn)\s+(\w+)\s*\("
# a braced function is this head, anything but a semicolon, and a closing parenthesis before a brace
BRACED_HEAD = r"\b(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("
BRACED_END = r"\)\s*\{"
NOT_BRACED_FUNCTIONS = ["if", "for", "while", "switch", "catch"]
STRUCT_ALIAS = r"typedef\s+struct\s+(\w+)?\s*\{[^}]*\}\s*(\w+)\s*;"
PLAIN_STRUCT = r"(?<!typedef\s)struct\s+(\w+)\s*\{"
C_HEAD = r"(?md)^(?:static\s+)?(?:const\s+)?(?:struct\s+)?([\w\s*]+?)\s+(\w+)\s*\("
C_END = r"\)\s*[{;]"
NOT_C_FUNCTIONS = ["if", "for", "while", "switch", "main"]
IMPORT = r"(?md)^\s*((?:import|from|using|require)\s+[^\n]+)"
VARIABLE = r"(?md)^\s*([A-Za-z_]\w*)\s*="
NOT_VARIABLES = ["if", "elif", "for", "while"]
PRINTED = r"""print\s*\(\s*f?["']([^"']+)["']"""

LINKS = "array<struct<owner:string,name:string>>"


def _all(c: Column, p: str, g: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(p), F.lit(g))


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _named(listed: Column, *others: str) -> Column:
    """Stripped entries of a comma-separated list but the empty and ``others``."""
    return F.filter(F.transform(F.split(listed, ","), X.strip), lambda x: (x != "") & ~x.isin(*others) if others else x != "")


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def python_methods(code: Column) -> Column:
    """(owner, name) of indented functions, by the state the lines above leave behind.

    A class line at the margin opens a type, any other code at the margin closes it; comments and
    decorators leave it open. So the text falls into stretches that start at a class line, and each
    ends with the first line that closes it.
    """
    stretches = F.filter(F.split(F.concat(F.lit("\n"), code), r"\nclass[ \t\x0B\f\r]+(?=\w)"), lambda _, i: i > 0)

    def of_type(s: Column) -> Column:
        inside = F.regexp_replace(s, r"(?s)\n[^ \t\n#@].*$", "")
        return F.transform(
            _all(inside, r"(?md)^[ \t\x0B\f\r]{4}def[ \t\x0B\f\r]+(\w+)"),
            lambda m: F.struct(F.regexp_extract(s, r"^(\w+)", 1).alias("owner"), m.alias("name")),
        )

    return F.flatten(F.transform(stretches, of_type))


def steps_of(code: Column) -> Column:
    """What comments and printed texts say, line by line."""
    telling = F.filter(F.transform(X.lines(code), X.strip), lambda x: F.startswith(x, F.lit("#")) | F.contains(x, F.lit("print")))

    def said(line: Column) -> Column:
        comment = F.when(F.startswith(line, F.lit("#")), X.strip(F.ltrim(line, F.lit("#"))))
        printed = X.strip(F.rtrim(F.regexp_extract(line, PRINTED, 1), F.lit(":")))
        return F.array(comment, X.strip(F.regexp_replace(printed, r"\{[^}]*\}", "<value>")))

    return F.filter(F.flatten(F.transform(telling, said)), lambda x: x.isNotNull() & (x != ""))


def _headed(stretches: Column, head: str, group: int, end: str) -> Column:
    """Per stretch the name in its first ``head`` before its last ``end``.

    A function's text from head to end holds no semicolon and reaches for the last end there is, so
    a stretch between semicolons names one function at most. Looking for the end first keeps
    every text linear; one pattern for both would run to the end of the stretch from every head.
    """
    ending = F.filter(stretches, lambda s: F.contains(s, F.lit(")")) & F.rlike(s, F.lit(end)))
    names = F.transform(ending, lambda s: F.regexp_extract(F.regexp_extract(s, f"(?s)^(.*){end}", 1), head, group))
    return F.filter(names, lambda n: n != "")


def braced_functions(code: Column) -> Column:
    return _headed(F.split(code, ";"), BRACED_HEAD, 1, BRACED_END)


def c_functions(code: Column) -> Column:
    """Functions of C by definition or declaration; a stretch keeps the semicolons around it, as
    one may end a declaration and what follows one does not start a line."""
    def whole(parts: Column) -> Column:
        return F.transform(
            parts, lambda s, i: F.concat(F.when(i > 0, F.lit(";")).otherwise(F.lit("")), s, F.when(i < F.size(parts) - 1, F.lit(";")).otherwise(F.lit("")))
        )

    return _headed(X.once(F.split(code, ";"), whole), C_HEAD, 2, C_END)


def owned(function: Column, types: Column, lows: Column) -> Column:
    """The first of ``types`` (``lows`` in lower case) that the function's name is or starts with, an
    underscore after it; else null."""
    heads = X.once(F.split(F.lower(function), "_"), lambda words: F.transform(words, lambda _, i: F.array_join(F.slice(words, 1, i + 1), "_")))
    places = F.filter(F.transform(heads, lambda h: F.array_position(lows, h)), lambda p: p > 0)
    return X.once(F.array_min(places), lambda p: F.when(p.isNotNull(), F.element_at(types, p.cast("int"))))


def with_structure(sources: DataFrame, code: str = "code") -> DataFrame:
    """Every source with ``language types bases methods functions imports variables steps``, from inside the row.

    ``bases`` are the parents each type was last declared with; ``methods`` are (owner, name).
    A null text has the language ``unknown`` and nothing else. Texts of any length are read whole.
    """
    c = F.col("__code")
    python, c_like = F.col("language") == "python", F.col("language").isin("c", "cpp")
    extended = F.zip_with(
        _all(c, BRACED_TYPE, 2), _all(c, BRACED_TYPE, 3), lambda e, i: F.concat(F.when(e != "", F.array(e)).otherwise(_none()), _named(i))
    )
    braced = F.filter(braced_functions(c), lambda n: ~n.isin(*NOT_BRACED_FUNCTIONS))
    known = sources.withColumn("__code", F.coalesce(F.col(code), F.lit("")))
    known = hold(known, {"language": CD.language(c)})
    read = hold(
        known,
        {
            "imports": F.transform(_all(c, IMPORT), X.strip),
            "variables": F.filter(_all(c, VARIABLE), lambda v: ~v.isin(*NOT_VARIABLES)),
            "steps": steps_of(c),
            "__names": F.when(python, _all(c, PYTHON_TYPE)).otherwise(_all(c, BRACED_TYPE)),
            "__parents": F.when(python, F.transform(_all(c, PYTHON_TYPE, 2), lambda b: _named(b, "object"))).otherwise(extended),
            "__structs": F.when(c_like, F.concat(_all(c, STRUCT_ALIAS, 2), _all(c, PLAIN_STRUCT))).otherwise(_none()),
            "__functions": F.when(python, _all(c, PYTHON_FUNCTION)).otherwise(F.concat(_all(c, KEYWORD_FUNCTION), braced)),
            "__c": F.when(c_like, F.filter(c_functions(c), lambda n: ~n.isin(*NOT_C_FUNCTIONS))).otherwise(_none()),
            "__methods": F.when(python, python_methods(c)).otherwise(_none(LINKS)),
        },
    )
    declared = F.filter(F.arrays_zip(F.col("__names").alias("n"), F.col("__parents").alias("p")), lambda d: F.size(d["p"]) > 0)
    found = hold(
        read,
        {
            "types": F.array_distinct(F.concat("__names", "__structs")),
            "functions": F.array_distinct(F.concat("__functions", "__c")),
            "__declared": declared,
        },
        [x for x in read.columns if x not in ("__names", "__parents", "__structs", "__functions", "__code")],
    )
    found = hold(found, {"__last": F.reverse("__declared"), "__lows": F.transform("types", F.lower)})
    found = hold(found, {"__owners": F.transform("__last", lambda d: d["n"])})
    bases = F.transform(
        F.array_distinct(F.reverse("__owners")),
        lambda n: F.struct(n.alias("owner"), F.get("__last", (F.array_position("__owners", n) - 1).cast("int"))["p"].alias("parents")),
    )
    by_name = F.transform(F.array_distinct("__c"), lambda f: F.struct(owned(f, F.col("types"), F.col("__lows")).alias("owner"), f.alias("name")))
    methods = F.concat("__methods", F.filter(by_name, lambda m: m["owner"].isNotNull()))
    return hold(found, {"bases": bases, "methods": methods}).drop("__declared", "__last", "__lows", "__owners", "__c", "__methods")


def with_facts(sources: DataFrame) -> DataFrame:
    """Every source with its structure and an array ``facts`` of (kind, name, owner), each once."""
    rows = with_structure(sources)

    def plain(kind: str, names: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit("").alias("owner")))

    def linked(kind: str, links: Column) -> Column:
        return F.transform(links, lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["owner"].alias("owner")))

    parents = F.flatten(
        F.transform("bases", lambda b: F.transform(b["parents"], lambda p: F.struct(b["owner"].alias("owner"), p.alias("name"))))
    )
    facts = F.concat(
        plain("type", "types"), linked("base", parents), plain("function", "functions"), linked("method", F.col("methods")),
        plain("import", "imports"), plain("variable", "variables"), plain("step", "steps"),
    )
    # distinct over strings is one hash pass; over structs every pair would be compared
    keys = F.array_distinct(F.transform(facts, lambda f: F.concat_ws("\u0001", f["kind"], f["name"], f["owner"])))
    rows = hold(rows, {"__keys": keys})
    parts = F.transform(
        F.transform("__keys", lambda k: F.split(k, "\u0001")),
        lambda p: F.struct(p[0].alias("kind"), p[1].alias("name"), p[2].alias("owner")),
    )
    return hold(rows, {"facts": parts}).drop("__keys")


def code_facts(sources: DataFrame) -> DataFrame:
    """One row per fact."""
    return with_facts(sources).select("artifact_id", "language", F.inline("facts"))


def process_steps(imports: Column, variables: Column, steps: Column, most: int | None = None) -> Column:
    """Stages of a script without types: what its structure shows, then what it says."""
    told = _first(F.filter(steps, lambda s: F.length(s) > 2), most)
    begun = F.concat(
        F.when(F.size(imports) > 0, F.array(F.lit("Import dependencies"))).otherwise(_none()),
        F.when(F.size(variables) > 0, F.array(F.lit("Configure paths / parameters"))).otherwise(_none()),
    )
    ended = (
        F.when(F.exists(told, lambda s: F.contains(F.lower(s), F.lit("success"))), F.array(F.lit("Report success")))
        .when(F.size(begun) > 0, F.array(F.lit("Finish")))
        .otherwise(_none())
    )
    found = F.array_distinct(F.concat(begun, ended, told))
    usual = F.array(*[F.lit(x) for x in ("Initialize", "Run script logic", "Finish")])
    return _first(F.when(F.size(found) > 0, found).otherwise(usual), most)


def spec_text(
    sources: DataFrame,
    diagram_type: Column | None = None,
    methods: int | None = None,
    imports: int | None = None,
    variables: int | None = None,
    steps: int | None = None,
    keep: Sequence[str] = ("artifact_id", "language"),
) -> DataFrame:
    """The specification text a source's structure gives, beside the columns to ``keep``; whole lists
    unless limits are given."""
    wanted = diagram_type if diagram_type is not None else F.lit("class")
    facts = with_structure(sources.withColumn("__type", wanted))
    typed, flow = F.size("types") > 0, F.col("__type") == "flowchart"
    facts = hold(facts, {"__steps": process_steps(F.col("imports"), F.col("variables"), F.col("steps"), steps)})

    def lines(values: Column, each) -> Column:
        return F.array_join(F.transform(values, each), "\n")

    def entity(t: Column) -> Column:
        own = F.transform(F.filter("methods", lambda m: m["owner"] == t), lambda m: m["name"])
        listed = F.coalesce(F.nullif(F.array_join(_first(own, methods), ", "), F.lit("")), F.lit("(no methods extracted)"))
        parents = F.flatten(F.transform(F.filter("bases", lambda b: b["owner"] == t), lambda b: b["parents"]))
        inherits = F.when(F.size(parents) > 0, F.concat(F.lit("\n  - inherits: "), F.array_join(parents, ", "))).otherwise(F.lit(""))
        return F.concat(F.lit("- "), t, F.lit(": "), listed, inherits)

    inheritance = F.flatten(
        F.transform("bases", lambda b: F.transform(b["parents"], lambda p: F.concat(F.lit("- "), b["owner"], F.lit(" inherits "), p)))
    )
    relations = (
        F.when(F.size("bases") > 0, F.array_join(inheritance, "\n"))
        .when(F.size("types") >= 2, F.concat(F.lit("- "), F.get("types", F.lit(0)), F.lit(" associates with "), F.get("types", F.lit(1))))
        .when(~typed, F.lit("- (none — no types to relate)"))
        .otherwise(F.lit("- (single type; no inter-type relationships extracted)"))
    )
    numbered = F.transform("__steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    spec = F.concat_ws(
        "\n",
        F.lit("## Technical Specification (from source code)"),
        F.concat(F.lit("### Detected language\n- "), F.col("language")),
        F.lit("### Source intent\nReverse-engineered structural model from provided source code."),
        F.lit("### Entities"),
        F.when(typed, lines(F.col("types"), entity)).otherwise(
            F.lit(
                "- (none — source is a script/driver with no class/interface declarations)\n"
                "  Do NOT invent classes from variable names or string literals."
            )
        ),
        F.lit("### Relationships"),
        relations,
        F.when(flow | ~typed, F.concat(F.lit("### Process steps\n"), F.array_join(numbered, "\n"))),
        F.when(
            F.size("imports") > 0,
            F.concat(F.lit("### Imports / dependencies\n"), lines(_first(F.col("imports"), imports), lambda i: F.concat(F.lit("- "), i))),
        ),
        F.when(
            ~typed & (F.size("variables") > 0),
            F.concat(
                F.lit("### Script configuration (not UML classes)\n"),
                lines(_first(F.col("variables"), variables), lambda v: F.concat(F.lit("- "), v, F.lit(": configuration / local binding"))),
            ),
        ),
        F.when(typed, F.lit("### Modules\n- domain: primary types from source")),
    )
    return hold(facts, {"spec": spec}, list(keep))
