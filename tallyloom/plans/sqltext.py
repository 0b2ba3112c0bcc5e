"""Text expressions of the independent SQL."""

NL = "chr(10)"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def unfenced(c: str) -> str:
    return f"regexp_replace(regexp_replace({stripped(c)}, '(?i)^```(?:plantuml)?\\s*', ''), '\\s*```$', '')"


BLOCKS = f"""SELECT artifact_id, diagram_type, plantuml_code, CASE WHEN b <> '' THEN b ELSE s END AS block FROM (
  SELECT *, regexp_extract(s, '(?is)@startuml.*?@enduml') AS b FROM (
    SELECT *, CASE WHEN NOT contains(lower(u), '@startuml') THEN concat('@startuml', {NL}, u, {NL}, '@enduml')
      WHEN NOT contains(lower(u), '@enduml') THEN concat(u, {NL}, '@enduml') ELSE u END AS s
    FROM (SELECT *, {unfenced('plantuml_code')} AS u FROM diagrams)))"""

ALL = "regexp_extract_all({c}, '{p}', {g})"
CLASS_RE = "(?im)^\\s*(?:abstract\\s+)?(?:class|interface|enum|annotation)\\s+([A-Za-z_][\\w.]*)"
OBJECT_RE = '(?im)^\\s*object\\s+(?:"[^"]+"\\s+as\\s+)?([A-Za-z_]\\w*)'
COMPONENT_RE = "(?im)^\\s*(?:\\[([^\\]]+)\\]|(?:component|node|folder|frame|cloud|database)\\s+([A-Za-z_][\\w.]*))"
PACKAGE_RE = '(?im)^\\s*package\\s+(?:"([^"]+)"|([A-Za-z_][\\w.]*))'


def every(c: str, p: str, g: int = 1) -> str:
    return f"regexp_extract_all({c}, '{p}', {g})"


def either(c: str, p: str) -> str:
    return f"list_transform({every(c, p, 1)}, lambda x, i: CASE WHEN coalesce(x, '') <> '' THEN x ELSE coalesce({every(c, p, 2)}[i], '') END)"


COMPONENTS = (
    "list_filter(list_transform(" + either("body", COMPONENT_RE) + ", lambda n: regexp_replace(regexp_extract("
    "trim(regexp_replace(trim(n), '(?i)\\s+as\\s+\\S+$', ''), ' \"'''), '^(\\S*)', 1), '[^\\w.]', '_', 'g')), lambda n: n <> '')"
)
DECLARED = f"""SELECT artifact_id, diagram_type, plantuml_code, block, body, {every('body', CLASS_RE)} AS classes, {every('body', OBJECT_RE)} AS objects,
  {COMPONENTS} AS components, list_filter(list_transform({either('body', PACKAGE_RE)}, lambda n: trim(n)), lambda n: n <> '') AS packages
  FROM (SELECT *, regexp_replace(block, '(?i)@startuml|@enduml', '', 'g') AS body FROM blocks)"""

ENTITY_RE = "(?im)^\\s*(?:abstract\\s+)?(?:class|interface|enum|object|component|package|node|database|queue|cloud)\\s+[\"''\\[\\{]?(\\w+)"
EDGE_RE = "(\\w+)\\s*(?:\\[)?\\s*(<\\|--|<\\|\\.\\.|--\\|>|\\.\\.\\|>|\\*--|o--|\\.\\.>|\\.\\.|-->|->)\\s*(?:\\[)?\\s*(\\w+)"
SELF_RE = "^\\s*([A-Za-z_][\\w.]*)\\s+(\\.\\.>|->|-->)\\s*([A-Za-z_][\\w.]*)"


def hit(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def said(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{m}' END" for m, t in rules) + "], lambda x: x IS NOT NULL)"


def repeats(c: str) -> str:
    return f"len({c}) <> len(list_distinct(list_transform({c}, lambda x: lower(x))))"


_BODY = "regexp_replace(regexp_replace(block, '(?im)@startuml|@enduml|^\\s*title\\b[^\\n]*$|^\\s*skinparam\\b[^\\n]*$', '', 'g'), '(?m)^\\s*(left to right direction|hide\\b.*|!theme\\b.*)$', '', 'g')"
SYNTAX = said(
    [
        ("Missing @startuml", "NOT contains(lower(block), '@startuml')"),
        ("Missing @enduml", "NOT contains(lower(block), '@enduml')"),
        ("Multiple @startuml blocks", "len(regexp_extract_all(lower(block), '@startuml')) > 1"),
        ("Unbalanced curly braces", "length(replace(block, '{', '')) <> length(replace(block, '}', ''))"),
        ("Diagram body is empty or incomplete", f"length({stripped(_BODY)}) < 8"),
        ("Invalid worded relationship arrow (use --|>, -->, *--, o--, ..>)", hit("block", "--\\s*[A-Za-z_]{3,}\\s*-->")),
    ]
)
_LINES = f"string_split(block, {NL})"
_SELF = (
    f"list_transform(list_filter({_LINES}, lambda l: regexp_extract(l, '{SELF_RE}', 1) <> '' AND "
    f"regexp_extract(l, '{SELF_RE}', 1) = regexp_extract(l, '{SELF_RE}', 3)), lambda l: 'Self-referential dependency')"
)
_PBLOCK = hit("block", "(?im)^\\s*package\\s+\\S[^\\n{]*\\{")
PACKAGE = (
    "list_concat(list_concat("
    + said(
        [
            ("Package diagram appears empty or incomplete", f"length({stripped('regexp_replace(block, ' + chr(39) + '(?im)@startuml|@enduml|^\\s*title\\b[^\\n]*$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}) < 12"),
            ("Package diagram has no package { } declarations", "NOT " + hit("block", "(?im)^\\s*package\\s+")),
            ("Package diagram needs package Name { ... } blocks, not bare package lines", "NOT " + _PBLOCK),
            (
                "Package blocks are empty (no nested types or dependencies)",
                f"{_PBLOCK} AND NOT {hit('body', '(?im)^\\s*(class|interface|component|package)\\s+\\w+')} AND NOT {hit('body', '\\.\\.>|->|-->|\\+--')}",
            ),
        ]
    )
    + f", {_SELF}), "
    + said(
        [
            (
                "Multiple dotted package names without nesting; prefer nested package { } for containment",
                f"len({every('block', 'package\\s+([A-Za-z0-9]+(?:\\.[A-Za-z0-9]+)+)')}) >= 2 AND NOT {hit('block', 'package\\s+\\w+\\s*\\{')}",
            ),
            (
                "Duplicate package names at declaration sites",
                f"len({every('block', '(?m)^package\\s+(\\w+)')}) <> len(list_distinct({every('block', '(?m)^package\\s+(\\w+)')}))",
            ),
        ]
    )
    + ")"
)
OBJECT = said(
    [
        (
            "Object instances should use name:Type syntax (e.g. object cart1 : Cart)",
            hit("block", "(?im)^\\s*object\\s+") + " AND NOT " + hit("block", "(?im)^\\s*object\\s+\\w+\\s*:\\s*\\w+")
            + " AND NOT " + hit("block", '(?im)^\\s*object\\s+"[^"]+\\s*:\\s*[^"]+"\\s+as\\s+\\w+'),
        ),
        ("Object '''' is missing :Type before attribute block", hit("block", "(?im)^\\s*object\\s+(\\w+)\\s*\\{")),
    ]
)
COMPONENT = said([("Empty component interface notation", hit("block", "(?m)\\(\\)\\s*$"))])
_STEP, _START, _STOP = hit("body", "(?m)^\\s*:[^;\\n]+;"), hit("body", "(?im)^\\s*start\\s*$"), hit("body", "(?im)^\\s*(stop|end)\\s*$")
_ACTIVE = f"({_START} OR {_STEP} OR {_STOP} OR contains(lower(body), 'endif'))"
FLOW = said(
    [
        (
            "Flowchart looks like a structural UML diagram; use activity syntax (start / :Step; / if / stop)",
            f"({hit('body', '(?m)^\\s*class\\s+\\w+')} OR {hit('body', '(?m)^\\s*object\\s+\\w+')}) AND NOT {_ACTIVE}",
        ),
        ("Flowchart has no activity steps (:Step;) or start", f"NOT {_STEP} AND NOT {_START}"),
        ("Flowchart has start but missing stop/end", f"{_START} AND NOT {_STOP}"),
        ("Flowchart steps should not use class-style --> arrows", f"{_ACTIVE} AND {hit('body', '(?m)^\\s*:\\w+.*-->\\s*\\w+')}"),
    ]
)
STRUCTURE = "CASE diagram_type WHEN 'class' THEN " + said(
    [
        ("Class diagram has no class/interface/enum declarations", "len(classes) = 0"),
        ("Duplicate class declarations", repeats("classes")),
        ("Unsupported worded relationship arrow", hit("body", "--\\s*[A-Za-z]+\\s*-->")),
    ]
) + " WHEN 'object' THEN " + said([("Object diagram has no object instances", "len(objects) = 0")]) + (
    " WHEN 'component' THEN "
) + said(
    [("Component diagram has no components", "len(components) = 0"), ("Duplicate component names", repeats("components"))]
) + " WHEN 'package' THEN " + said(
    [
        ("Package diagram has no package declarations", "len(packages) = 0"),
        ("Package diagram needs nested package { } blocks", "NOT " + hit("body", "(?i)package\\s+.+\\s*\\{")),
    ]
) + " WHEN 'sequence' THEN ['Sequence diagrams are not a supported generation type in this pipeline'] ELSE [] END"
TYPED = f"CASE diagram_type WHEN 'package' THEN {PACKAGE} WHEN 'object' THEN {OBJECT} WHEN 'component' THEN {COMPONENT} WHEN 'flowchart' THEN {FLOW} ELSE [] END"

_LOW = "lower(plantuml_code)"


def _in(*words: str) -> str:
    return "(" + " OR ".join(f"contains(c, '{w}')" for w in words) + ")"


INFERRED = (
    f"CASE WHEN {_in('usecase')} OR {hit('c', '\\bactor\\s+')} THEN 'usecase' "
    f"WHEN {hit('c', '\\bobject\\s+\\w+')} OR {_in('object \"')} THEN 'object' "
    f"WHEN {_in('package ')} THEN 'package' WHEN {hit('c', '\\bcomponent\\s+')} OR {hit('c', '\\[.+\\]\\s+as\\s+')} THEN 'component' "
    f"WHEN {_in('[*]')} OR {hit('c', '\\bstate\\s+')} THEN 'state' WHEN {hit('c', '\\bnode\\s+')} OR {_in('cloud ')} THEN 'deployment' "
    f"WHEN {_in('participant ')} THEN 'sequence' WHEN ({hit('c', '(?m)^\\s*start\\s*$')} OR {hit('c', '(?m)^\\s*stop\\s*$')} OR {_in('if (')} "
    f"OR {hit('c', '(?m)^\\s*:[^;]+;')}) AND NOT {_in('class ')} THEN 'flowchart' "
    f"WHEN {_in('class ', 'abstract ', 'interface ', 'enum ')} THEN 'class' ELSE 'unknown' END"
)
