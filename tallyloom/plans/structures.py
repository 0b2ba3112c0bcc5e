"""Text-structure jobs."""

from pyspark.sql import functions as F

from ..functions import code as CD
from ..operators import codefacts as CF, structure as ST
from . import sqltext as Q
from .catalog import query
from .gating import code_like


@query(
    "l01_entity_facts",
    """SELECT artifact_id, 'class' AS kind, unnest(classes) AS name, generate_subscripts(classes, 1) - 1 AS pos FROM declared
    UNION ALL SELECT artifact_id, 'object', unnest(objects), generate_subscripts(objects, 1) - 1 FROM declared
    UNION ALL SELECT artifact_id, 'component', unnest(components), generate_subscripts(components, 1) - 1 FROM declared
    UNION ALL SELECT artifact_id, 'package', unnest(packages), generate_subscripts(packages, 1) - 1 FROM declared""",
    "declared",
)
def _(t):
    return ST.entity_facts(t.diagrams)


@query(
    "l01_entity_frequency",
    f"""SELECT name, count(DISTINCT artifact_id) AS diagrams FROM (SELECT artifact_id, unnest({Q.every('plantuml_code', Q.ENTITY_RE)}) AS name FROM diagrams)
    WHERE lower(name) NOT IN ('as','note','title','legend','left','right','top','bottom') GROUP BY name""",
    "diagrams",
)
def _(t):
    return ST.entity_frequency(t.diagrams)


@query(
    "l02_type_census",
    f"SELECT diagram_type, {Q.INFERRED} AS inferred, count(*) AS n FROM (SELECT diagram_type, lower(plantuml_code) AS c FROM diagrams) GROUP BY ALL",
    "diagrams",
)
def _(t):
    return ST.type_census(t.diagrams)


@query(
    "l03_syntax_rules",
    f"SELECT diagram_type, rule, count(*) AS n FROM (SELECT diagram_type, unnest({Q.SYNTAX}) AS rule FROM declared) GROUP BY ALL",
    "declared",
)
def _(t):
    return ST.rule_counts(ST.checked(t.diagrams), F.col("syntax"))


@query(
    "l04_type_rules",
    f"SELECT diagram_type, rule, count(*) AS n FROM (SELECT diagram_type, unnest({Q.TYPED}) AS rule FROM declared) GROUP BY ALL",
    "declared",
)
def _(t):
    return ST.rule_counts(ST.checked(t.diagrams), F.col("typed"))


@query(
    "l04_flowchart_rules",
    f"""SELECT diagram_type, rule, count(*) AS n FROM (SELECT diagram_type, unnest({Q.TYPED}) AS rule
    FROM (SELECT * REPLACE ('flowchart' AS diagram_type) FROM declared)) GROUP BY ALL""",
    "declared",
)
def _(t):
    flow = t.diagrams.withColumn("diagram_type", F.lit("flowchart"))
    return ST.rule_counts(ST.checked(flow), F.col("typed"))


@query(
    "l04_structure_rules",
    f"SELECT diagram_type, rule, count(*) AS n FROM (SELECT diagram_type, unnest({Q.STRUCTURE}) AS rule FROM declared) GROUP BY ALL",
    "declared",
)
def _(t):
    return ST.rule_counts(ST.checked(t.diagrams), F.col("rules"))


EDGES = f"""SELECT artifact_id, line_no, op, CASE WHEN op IN ('--|>', '..|>') THEN b ELSE a END AS src, CASE WHEN op IN ('--|>', '..|>') THEN a ELSE b END AS dst,
  CASE WHEN op IN ('--|>', '..|>', '<|--', '<|..') THEN 'inherit' ELSE 'assoc' END AS kind FROM (
  SELECT artifact_id, line_no, regexp_extract(line, '{Q.EDGE_RE}', 1) AS a, regexp_extract(line, '{Q.EDGE_RE}', 2) AS op, regexp_extract(line, '{Q.EDGE_RE}', 3) AS b
  FROM (SELECT artifact_id, unnest(string_split(plantuml_code, chr(10))) AS line, generate_subscripts(string_split(plantuml_code, chr(10)), 1) - 1 AS line_no FROM diagrams)
  WHERE NOT regexp_matches(line, '^\\s*''')) e
  WHERE op <> '' AND EXISTS (SELECT 1 FROM known k WHERE k.artifact_id = e.artifact_id AND k.name = e.a) AND EXISTS (SELECT 1 FROM known k WHERE k.artifact_id = e.artifact_id AND k.name = e.b)"""
KNOWN = f"known AS (SELECT DISTINCT artifact_id, unnest({Q.every('plantuml_code', Q.ENTITY_RE)}) AS name FROM diagrams)"


@query("l05_edge_facts", f"WITH {KNOWN} {EDGES}", "diagrams")
def _(t):
    return ST.edge_facts(t.diagrams)


@query(
    "l05_edge_summary",
    f"WITH {KNOWN} SELECT op, kind, count(*) AS edges, count(DISTINCT artifact_id) AS diagrams FROM ({EDGES}) GROUP BY op, kind",
    "diagrams",
)
def _(t):
    return ST.edge_summary(ST.edge_facts(t.diagrams))


DEGREES = f"""SELECT artifact_id, name, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
  SELECT artifact_id, src AS name, 1 AS o, 0 AS i FROM ({EDGES}) UNION ALL SELECT artifact_id, dst, 0, 1 FROM ({EDGES})) GROUP BY ALL"""


@query("l05_degrees", f"WITH {KNOWN} {DEGREES}", "diagrams")
def _(t):
    return ST.edge_degrees(ST.edge_facts(t.diagrams))


@query(
    "l05_hubs",
    f"WITH {KNOWN} SELECT name, count(*) AS diagrams, sum(out_degree)::BIGINT AS out_degree, sum(in_degree)::BIGINT AS in_degree, max(out_degree + in_degree)::BIGINT AS most_in_a_diagram FROM ({DEGREES}) GROUP BY name",
    "diagrams",
)
def _(t):
    return ST.hubs(ST.edge_degrees(ST.edge_facts(t.diagrams)))


@query(
    "l05_centres",
    f"""WITH {KNOWN}, d AS ({DEGREES}) SELECT artifact_id, name AS centre, degree, entities FROM (
      SELECT artifact_id, name, (out_degree + in_degree)::BIGINT AS degree, count(*) OVER (PARTITION BY artifact_id) AS entities, row_number() OVER (PARTITION BY artifact_id ORDER BY out_degree + in_degree DESC, name) AS place FROM d) WHERE place = 1""",
    "diagrams",
)
def _(t):
    return ST.centres(ST.edge_degrees(ST.edge_facts(t.diagrams)))


UNSAFE = "(?i)^\\s*!(?:include|includeurl|import|pragma|define|undef|definelong|enddefinelong|startsub|endsub|function|endfunction|procedure|endprocedure|return|exit|theme|includesub)\\b"
STYLED = "(?i)^\\s*skinparam\\b|^\\s*style\\s+\\S|\\b(?:BackgroundColor|FontColor|BorderColor|ArrowColor|LineColor|Shadowing|RoundCorner|Gradient)\\b"
WORDED = "^(\\s*)([A-Za-z_][\\w.]*)\\s+--\\s*([A-Za-z_]+)\\s*-->\\s*([A-Za-z_][\\w.]*)\\s*;?\\s*$"
LINES = "SELECT artifact_id, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS pos FROM blocks"
KEY = "CASE WHEN trim(line) = '' OR trim(line) LIKE '@%' OR trim(line) LIKE '%}' THEN concat(chr(1), pos) ELSE trim(line) END"


@query(
    "l06_cleaning_counts",
    f"""WITH l AS ({LINES}), n AS (SELECT artifact_id, count(*) FILTER (WHERE regexp_matches(line, '{UNSAFE}')) AS unsafe,
      count(*) FILTER (WHERE regexp_matches(line, '{STYLED}')) AS style, count(*) FILTER (WHERE regexp_matches(line, '{WORDED}')) AS worded_arrow,
      count(*) - count(DISTINCT {KEY}) AS repeated FROM l GROUP BY artifact_id)
    SELECT rule, sum(n)::BIGINT AS lines, count(*) FILTER (WHERE n > 0) AS diagrams FROM n UNPIVOT (n FOR rule IN (unsafe, style, worded_arrow, repeated)) GROUP BY rule""",
    "blocks",
)
def _(t):
    return ST.cleaning_counts(t.diagrams)


_SIGN = """CASE lower(regexp_extract(line, '{w}', 3)) WHEN 'inheritance' THEN '--|>' WHEN 'uses' THEN '..>' ELSE '-->' END""".format(w=WORDED)
_DECL = "(?i)^(\\s*(?:class|interface|enum|abstract\\s+class)\\s+\\S+)\\s*;\\s*$"


@query(
    "l06_clean_diagram",
    f"""WITH l AS ({LINES}),
    r AS (SELECT artifact_id, pos, CASE WHEN regexp_matches(line, '{_DECL}') THEN regexp_extract(line, '{_DECL}', 1)
      WHEN regexp_matches(line, '{WORDED}') THEN concat(regexp_extract(line, '{WORDED}', 1), regexp_extract(line, '{WORDED}', 2), ' ', {_SIGN}, ' ', regexp_extract(line, '{WORDED}', 4))
      ELSE rtrim(line) END AS line FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, {KEY} ORDER BY pos) AS place FROM r WHERE NOT regexp_matches(line, '{UNSAFE}')),
    t AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE place = 1 GROUP BY artifact_id),
    b AS (SELECT artifact_id, CASE WHEN opens > closes THEN replace(text, '@enduml', concat(repeat('}}', opens - closes), chr(10), '@enduml')) ELSE text END AS text
      FROM (SELECT *, (length(text) - length(replace(text, '{{', '')))::INT AS opens, (length(text) - length(replace(text, '}}', '')))::INT AS closes FROM t)),
    c AS (SELECT artifact_id, pos, rtrim(regexp_replace(regexp_replace(line, '#[0-9A-Fa-f]{{3,8}}\\b', '', 'g'), '\\s+#[A-Za-z]\\w*', '', 'g')) AS line FROM (
      SELECT artifact_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM b)
      WHERE NOT regexp_matches(line, '{STYLED}') AND NOT regexp_matches(line, '{UNSAFE}'))
    SELECT artifact_id, md5(string_agg(CASE WHEN pos = 1 THEN concat(line, chr(10), array_to_string(['skinparam monochrome true', 'skinparam shadowing false', 'skinparam backgroundColor white',
      'skinparam defaultFontColor black', 'skinparam ArrowColor black', 'skinparam ClassBorderColor black', 'skinparam PackageBorderColor black', 'skinparam ComponentBorderColor black',
      'skinparam ObjectBorderColor black', 'skinparam NoteBorderColor black', 'skinparam dpi 150'], chr(10))) ELSE line END, chr(10) ORDER BY pos)) AS digest
    FROM c WHERE trim(line) <> '' GROUP BY artifact_id""",
    "blocks",
)
def _(t):
    cleaned = ST.cleaned(t.diagrams, max_lines=None)
    return cleaned.select("artifact_id", F.md5("plantuml_code").alias("digest"))


@query(
    "l07_code_like",
    f"""SELECT artifact_id % 6 AS kind, CASE WHEN {code_like('code')} THEN 'source_code' ELSE 'requirement' END AS mode, count(*) AS n
    FROM code_sources GROUP BY ALL""",
    "code_sources",
)
def _(t):
    mode = CD.resolve_mode(F.col("code"), F.lit("requirement"))
    return t.code_sources.groupBy((F.col("artifact_id") % 6).alias("kind"), mode.alias("mode")).agg(F.count("*").alias("n"))


def _m(p):
    return f"regexp_matches(code, '(?m){p}')"


_SCRIPT = "\\b(function|const|let|var|export\\s+class|interface)\\b"
_PY = ["^\\s*#", "\\bprint\\s*\\(", "\\binput\\s*\\(", "\\belif\\b", "\\b(True|False|None)\\b", "\\bimport\\s+\\w", "\\bfrom\\s+\\w+\\s+import", "\\bint\\s*\\(", "\\bfloat\\s*\\(", "\\bstr\\s*\\("]
_C = f"({_m('^\\s*#\\s*include\\s*[<\"]')} OR {_m('\\btypedef\\s+struct\\b')})"


def _has(*words):
    return "(" + " AND ".join(f"contains(code, '{w}')" for w in words) + ")"


LANGUAGE = (
    f"CASE WHEN {_C} AND {_m('\\bstd::|namespace\\s+\\w+|class\\s+\\w+\\s*:\\s*public')} THEN 'cpp' WHEN {_C} THEN 'c' "
    f"WHEN {_m('\\b(public|private|protected)\\s+(class|interface|enum)\\s+\\w+')} OR {_m('^\\s*import\\s+[\\w.*]+\\s*;\\s*$|^\\s*package\\s+[\\w.]+\\s*;\\s*$')} "
    f"OR ({_m('^\\s*(public\\s+)?class\\s+\\w+\\s*\\{')} AND {_m('\\b(boolean|void|String|int|double|float|long)\\b')}) THEN 'java' "
    f"WHEN {_m('^\\s*def\\s+\\w+')} OR {_m('^\\s*class\\s+\\w+[^:{]*:')} OR {' + '.join(_m(p) + '::INT' for p in _PY)} >= 2 THEN 'python' "
    f"WHEN {_m(_SCRIPT)} AND {_has(':', '=>')} THEN 'typescript' WHEN {_m(_SCRIPT)} THEN 'javascript' "
    f"WHEN {_has('fn ')} AND ({_has('impl ')} OR {_has('struct ')}) THEN 'rust' "
    f"WHEN ({_m('^\\s*package\\s+\\w+|func\\s+\\(\\w+\\s+\\*')} OR ({_has('func ')} AND contains(replace(code, ' ', ''), 'struct{{'))) AND {_has('func ', 'package ')} THEN 'go' "
    f"WHEN {_has('namespace ')} AND {_m('\\bpublic\\s+class\\b')} THEN 'csharp' WHEN {_m('\\b(fun |open class |val |var )\\b')} AND {_has('class ')} THEN 'kotlin' "
    f"WHEN {_m('\\b(func |var |let |class )\\b')} AND {_has('->')} THEN 'swift' "
    f"WHEN {_m('\\bclass\\s+\\w+\\s*(:|\\{)|#include\\b')} AND ({_has('public:')} OR {_has('std::')} OR {_has('};')}) AND ({_has('public:')} OR {_m('class\\s+\\w+\\s*:\\s*public')}) THEN 'cpp' "
    f"WHEN {_m('\\b(attr_accessor|def\\s+\\w+|end\\b)')} AND {_has('class ')} THEN 'ruby' "
    f"WHEN {_has('<?php')} OR ({_m('\\bfunction\\s+\\w+\\s*\\(.*\\)\\s*\\{')} AND {_has('class ', '$')}) THEN 'php' "
    f"WHEN {_m('\\b(def |extends |val )\\b')} AND {_has('class ', ':')} THEN 'scala' WHEN {_has('class ', '=>', ';')} THEN 'dart' "
    f"WHEN {_has('defmodule ')} OR {_has('do:')} THEN 'elixir' WHEN {_m('\\bdata\\s+\\w+\\s*=')} OR {_has('::', '->')} THEN 'haskell' "
    f"WHEN {_has('setRefClass')} OR {_has('<-', 'function(')} THEN 'r' WHEN {_has('classdef ')} THEN 'matlab' WHEN {_has('package ', 'bless')} THEN 'perl' "
    f"WHEN {_has('function ', 'end', 'setmetatable')} THEN 'lua' ELSE 'unknown' END"
)


@query(
    "l08_language_census",
    f"SELECT artifact_id % 6 AS kind, {LANGUAGE} AS language, count(*) AS n FROM code_sources GROUP BY ALL",
    "code_sources",
)
def _(t):
    return t.code_sources.groupBy((F.col("artifact_id") % 6).alias("kind"), CD.language(F.col("code")).alias("language")).agg(
        F.count("*").alias("n")
    )


@query(
    "l08_language_of_prose",
    f"SELECT {LANGUAGE} AS language, count(*) AS n FROM (SELECT text AS code FROM documents) GROUP BY ALL",
)
def _(t):
    return t.texts.groupBy(CD.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


OWNER = "(?m)^\\s*class\\s+(\\w+)(?:\\s*\\(([^)]*)\\))?:"
BRACED = "\\b(?:class|interface|enum)\\s+(\\w+)(?:\\s+extends\\s+(\\w+))?(?:\\s+implements\\s+([\\w,\\s]+))?"


#: sources with what the templates lack: scripts, decorators and margins, prototypes, implemented interfaces
PROGRAM = (
    "CASE artifact_id % 12 "
    "WHEN 1 THEN concat('# Load table ', artifact_id, '\n##  \nimport os\nfrom sys import argv\nsource_path = \"in\"\n  out_path = argv\nif = 1\n"
    "print(f\"Reading {source_path}: \")\n  print(\"Saved with success\")\nsource_path = out_path\n# ok\n') "
    "WHEN 2 THEN concat(code, 'struct Plain {\n  int a;\n};\nstatic int free_all(int n);\nvoid plain_go(int n) {\n}\nint main(void) {\n  while (n) {\n  }\n}\n') "
    "WHEN 7 THEN concat(code, '@wraps\ndef outside():\n    def inner():\n        pass\nclass Tail(Base, object):\n    @property\n    def size(self):\n"
    "        return 1\n\n# note\n    def late(self):\n        pass\n@other\n    def kept(self):\n        pass\nvalue = 3\n    def lost(self):\n        pass\n"
    "class Tail:\n    def size(self):\n        pass\nclass Tail(First, Second):\n    pass\n') "
    "WHEN 6 THEN concat(code, 'class Last extends One implements Two, Three {\n  static List<String> names(int a) {\n  }\n  for (;;) {\n  }\n}\n') "
    "WHEN 9 THEN concat(code, 'function start(x) { go(); }\nfn(a) {\n}\n') "
    "WHEN 11 THEN concat('print(\"Success of {it}::\")\nelif\n', code) ELSE code END"
)


def _once(c):
    """Distinct in order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _trimmed(c):
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


_E = "regexp_extract_all(code, '{p}', {g})".format
_DEF = "(?m)^\\s*def\\s+(\\w+)\\s*\\("
_KEYWORD = "\\b(?:function|func|fn)\\s+(\\w+)\\s*\\("
_BRACES = "\\b(?:public|private|protected)?\\s*(?:static\\s+)?[\\w<>\\[\\]]+\\s+(\\w+)\\s*\\([^;]*\\)\\s*\\{"
_ALIAS = "typedef\\s+struct\\s+(\\w+)?\\s*\\{[^}]*\\}\\s*(\\w+)\\s*;"
_CFUN = "(?m)^(?:static\\s+)?(?:const\\s+)?(?:struct\\s+)?([\\w\\s*]+?)\\s+(\\w+)\\s*\\([^;]*\\)\\s*(?:\\{|;)"
_PRINT = "print\\s*\\(\\s*f?[\"'']([^\"'']+)[\"'']"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CODE_READ = f"""p AS (SELECT artifact_id, {PROGRAM} AS code FROM code_sources), s AS (SELECT *, {LANGUAGE} AS language FROM p),
  r AS (SELECT artifact_id, language, code,
    list_transform({_E(p='(?m)^\\s*((?:import|from|using|require)\\s+[^\\n]+)', g=1)}, lambda x: trim(x, {_WHITE})) AS imports,
    list_filter({_E(p='(?m)^\\s*([A-Za-z_]\\w*)\\s*=', g=1)}, lambda x: x NOT IN ('if', 'elif', 'for', 'while')) AS variables,
    list_filter(flatten(list_transform(list_transform(string_split(code, chr(10)), lambda l: trim(l, {_WHITE})), lambda l: [
      CASE WHEN l[1] = '#' THEN trim(ltrim(l, '#'), {_WHITE}) ELSE '' END,
      trim(regexp_replace(trim(rtrim(regexp_extract(l, '{_PRINT}', 1), ':'), {_WHITE}), '\\{{[^}}]*\\}}', '<value>', 'g'), {_WHITE})])), lambda x: x <> '') AS steps,
    CASE WHEN language = 'python' THEN {_E(p=OWNER, g=1)} ELSE {_E(p=BRACED, g=1)} END AS names,
    CASE WHEN language = 'python' THEN list_transform({_E(p=OWNER, g=2)}, lambda b: list_filter({_trimmed('b')}, lambda x: x <> 'object'))
      ELSE list_transform(list_zip({_E(p=BRACED, g=2)}, {_E(p=BRACED, g=3)}), lambda z: list_concat(list_filter([coalesce(z[1], '')], lambda x: x <> ''), {_trimmed("coalesce(z[2], '')")})) END AS parents,
    CASE WHEN language IN ('c', 'cpp') THEN list_concat({_E(p=_ALIAS, g=2)}, regexp_extract_all(regexp_replace(code, 'typedef\\sstruct', 'typedef', 'g'), 'struct\\s+(\\w+)\\s*\\{{', 1)) ELSE [] END AS structs,
    CASE WHEN language = 'python' THEN {_E(p=_DEF, g=1)} ELSE list_concat({_E(p=_KEYWORD, g=1)}, list_filter({_E(p=_BRACES, g=1)}, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'catch'))) END AS plain,
    CASE WHEN language IN ('c', 'cpp') THEN list_filter({_E(p=_CFUN, g=2)}, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'main')) ELSE [] END AS cfun
  FROM s),
  q AS (SELECT *, {_once('list_concat(names, structs)')} AS types, {_once('list_concat(plain, cfun)')} AS functions,
    list_filter(list_transform(list_zip(names, parents), lambda z: {{'owner': z[1], 'parents': z[2]}}), lambda d: len(d.parents) > 0) AS declared FROM r),
  ml AS (SELECT artifact_id, row_number() OVER () AS part, chunk FROM (SELECT artifact_id, unnest(regexp_split_to_array(chr(10) || code, '\\nclass[ \\t\\f\\r]+')[2:]) AS chunk FROM s WHERE language = 'python')),
  m AS (SELECT artifact_id, part, unnest(regexp_extract_all(regexp_replace(chunk, '(?s)\\n[^ \\t\\n#@].*$', ''), '(?m)^[ \\t\\f\\r]{{4}}def[ \\t\\f\\r]+(\\w+)', 1)) AS name,
      regexp_extract(chunk, '^(\\w+)', 1) AS owner, generate_subscripts(regexp_extract_all(regexp_replace(chunk, '(?s)\\n[^ \\t\\n#@].*$', ''), '(?m)^[ \\t\\f\\r]{{4}}def[ \\t\\f\\r]+(\\w+)', 1), 1) AS i FROM ml
    UNION ALL SELECT artifact_id, 0, f, list_filter(types, lambda t: lower(f) = lower(t) OR starts_with(lower(f), lower(t) || '_'))[1], i FROM (
      SELECT artifact_id, types, unnest({_once('cfun')}) AS f, generate_subscripts({_once('cfun')}, 1) AS i FROM q)),
  bases AS (SELECT artifact_id, k AS owner, list_filter(declared, lambda d: d.owner = k)[-1].parents AS parents, i FROM (
    SELECT artifact_id, declared, unnest({_once('list_transform(declared, lambda d: d.owner)')}) AS k, generate_subscripts({_once('list_transform(declared, lambda d: d.owner)')}, 1) AS i FROM q))"""


@query(
    "l09_code_facts",
    f"""WITH {CODE_READ} SELECT artifact_id, kind, name, owner FROM (
      SELECT artifact_id, 'type' AS kind, unnest(types) AS name, '' AS owner FROM q UNION ALL SELECT artifact_id, 'function', unnest(functions), '' FROM q
      UNION ALL SELECT artifact_id, 'base', unnest(parents), owner FROM bases UNION ALL SELECT artifact_id, 'method', name, owner FROM m WHERE owner IS NOT NULL
      UNION ALL SELECT artifact_id, 'import', unnest(imports), '' FROM q UNION ALL SELECT artifact_id, 'variable', unnest(variables), '' FROM q
      UNION ALL SELECT artifact_id, 'step', unnest(steps), '' FROM q) GROUP BY ALL""",
    "code_sources",
)
def _(t):
    return CF.code_facts(t.code_sources.selectExpr("artifact_id", f"{PROGRAM} AS code")).drop("language")


@query(
    "l09_code_spec_text",
    f"""WITH {CODE_READ},
    mm AS (SELECT artifact_id, owner, string_agg(name, ', ' ORDER BY part, i) AS methods FROM m WHERE owner IS NOT NULL GROUP BY ALL),
    ent AS (SELECT e.artifact_id, string_agg('- ' || t || ': ' || coalesce(methods, '(no methods extracted)') || coalesce(chr(10) || '  - inherits: ' || array_to_string(parents, ', '), ''), chr(10) ORDER BY n) AS entities
      FROM (SELECT artifact_id, unnest(types) AS t, generate_subscripts(types, 1) AS n FROM q) e LEFT JOIN mm ON mm.artifact_id = e.artifact_id AND mm.owner = t LEFT JOIN bases ON bases.artifact_id = e.artifact_id AND bases.owner = t GROUP BY ALL),
    inh AS (SELECT artifact_id, string_agg(array_to_string(list_transform(parents, lambda p: '- ' || owner || ' inherits ' || p), chr(10)), chr(10) ORDER BY i) AS inherited FROM bases GROUP BY ALL),
    st AS (SELECT *, list_filter(steps, lambda x: length(x) > 2) AS told, list_concat(CASE WHEN len(imports) > 0 THEN ['Import dependencies'] ELSE [] END, CASE WHEN len(variables) > 0 THEN ['Configure paths / parameters'] ELSE [] END) AS begun FROM q),
    se AS (SELECT *, list_concat(begun, CASE WHEN len(list_filter(told, lambda x: contains(lower(x), 'success'))) > 0 THEN ['Report success'] WHEN len(begun) > 0 THEN ['Finish'] ELSE [] END, told) AS every FROM st),
    sd AS (SELECT *, CASE WHEN len(every) > 0 THEN {_once('every')} ELSE ['Initialize', 'Run script logic', 'Finish'] END AS stages FROM se),
    x AS (SELECT artifact_id, concat('## Technical Specification (from source code)\n### Detected language\n- ', language, '\n### Source intent\nReverse-engineered structural model from provided source code.\n### Entities\n',
      CASE WHEN len(types) > 0 THEN entities ELSE '- (none — source is a script/driver with no class/interface declarations)\n  Do NOT invent classes from variable names or string literals.' END,
      '\n### Relationships\n', CASE WHEN inherited IS NOT NULL THEN inherited WHEN len(types) >= 2 THEN '- ' || types[1] || ' associates with ' || types[2]
        WHEN len(types) = 0 THEN '- (none — no types to relate)' ELSE '- (single type; no inter-type relationships extracted)' END,
      CASE WHEN len(types) = 0 OR artifact_id % 4 = 3 THEN '\n### Process steps\n' || array_to_string(list_transform(stages, lambda x, i: i || '. ' || x), chr(10)) ELSE '' END,
      CASE WHEN len(imports) > 0 THEN '\n### Imports / dependencies\n' || array_to_string(list_transform(imports, lambda x: '- ' || x), chr(10)) ELSE '' END,
      CASE WHEN len(types) = 0 AND len(variables) > 0 THEN '\n### Script configuration (not UML classes)\n' || array_to_string(list_transform(variables, lambda x: '- ' || x || ': configuration / local binding'), chr(10)) ELSE '' END,
      CASE WHEN len(types) > 0 THEN '\n### Modules\n- domain: primary types from source' ELSE '' END) AS spec
      FROM sd LEFT JOIN ent USING (artifact_id) LEFT JOIN inh USING (artifact_id))
    SELECT artifact_id, length(spec) AS chars, md5(spec) AS digest FROM x""",
    "code_sources",
)
def _(t):
    sources = t.code_sources.selectExpr("artifact_id", f"{PROGRAM} AS code")
    spec = CF.spec_text(sources, F.when(F.col("artifact_id") % 4 == 3, "flowchart").otherwise("class"))
    return spec.select("artifact_id", F.length("spec").alias("chars"), F.md5("spec").alias("digest"))


@query(
    "l18_fallback_rate",
    f"""SELECT diagram_type, count(*) AS n, round(count(*) FILTER (WHERE (len(c) > 0 AND len(list_filter(c, lambda x: x NOT IN ('entity','entities','detected','language','unknown','model','class','process','module','module1','module2'))) = 0)
      OR len(syntax) > 0 OR (len(e) > 0 AND len(list_filter(e, lambda x: contains(lower(plantuml_code), lower(x)))) = 0)) / count(*), 6) AS fallback_rate
    FROM (SELECT diagram_type, plantuml_code, {Q.SYNTAX} AS syntax, list_transform(regexp_extract_all(plantuml_code, '(?im)^\\s*class\\s+(\\w+)', 1), lambda x: lower(x)) AS c, n AS e
      FROM blocks JOIN spec_names USING (artifact_id)) GROUP BY diagram_type""",
    "blocks spec_names",
)
def _(t):
    from .reporting import rounded

    both = ST.checked(t.diagrams.join(t.spec_names.select(F.col("doc_id").alias("artifact_id"), "n"), "artifact_id"))
    flag = ST.needs_fallback(F.col("plantuml_code"), F.col("n"), F.size("syntax") == 0)
    out = both.groupBy("diagram_type").agg(F.count("*").alias("n"), (F.count_if(flag) / F.count("*")).alias("fallback_rate"))
    return rounded(out, "fallback_rate")
