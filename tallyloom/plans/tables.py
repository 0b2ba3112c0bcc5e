"""The entity views the registered queries run on.

Every view is derived from the whole of a given table.  ``VIEW_SQL`` holds the same definition
as plain SQL for the independent check; expressions both engines read alike are shared.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sqltext
from ..operators import scores as S
from ..operators.hold import dealt, hold, spread

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# expressions shared by both engines -------------------------------------------------------
TYPE_OF_LANG = (
    "CASE lang WHEN 'en' THEN 'class' WHEN 'fr' THEN 'object' WHEN 'de' THEN 'component' "
    "WHEN 'es' THEN 'package' END"
)
ARTIFACT_EXPRS = [
    "doc_id AS artifact_id",
    f"{TYPE_OF_LANG} AS diagram_type",
    "doc_id % 10 <> 0 AS render_ok",
    "CASE WHEN doc_id % 10 <> 0 THEN 'success' ELSE 'failed' END AS render_status",
    "CASE WHEN doc_id % 3 = 0 THEN 'source_code' ELSE 'requirement' END AS input_mode",
    "CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'python' "
    "WHEN 2 THEN 'C' END END AS source_language",
    "source AS source_dataset",
    "text AS plantuml_code",
    "text AS source_requirement",
    "text AS technical_spec",
    "cast(floor(doc_id / 5) AS bigint) AS job_id",
    "CASE WHEN doc_id % 7 <> 0 THEN concat('img/', cast(doc_id AS string), '.png') END AS image_path",
    "CASE WHEN doc_id % 6 = 0 THEN 'Diagram body is empty or incomplete' WHEN doc_id % 6 = 1 "
    "THEN 'Self-referential dependency: a ..> a' END AS validation_messages",
    "1704067200 + doc_id * 60 AS created_s",
]
SCORE_EXPRS = [
    "doc_id AS artifact_id", "model_key", "weight",
    "(doc_id + i) % 11 <> 0 AS available",
    "CASE WHEN (doc_id + i) % 11 <> 0 THEN "
    "cast((doc_id * (i + 1) + i * 3 + doc_id % 5) % 7 AS int) END AS score",
    "CASE WHEN doc_id % 13 = i THEN 'Mock VLM reply' ELSE 'checked' END AS explanation",
    "CASE WHEN (doc_id + i) % 11 = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http 500' "
    "ELSE 'no reply' END END AS error",
    "1704067200 + doc_id * 60 + i AS created_s",
]
AXIS = (
    "CASE WHEN doc_id % 4 = 0 THEN least(5, greatest(1, {s})) ELSE {s} END"
)


def _axis(j: int) -> str:
    s = f"least(6, greatest(0, quality * 3 - toxic + (doc_id * r + {j}) % 4))"
    return f"cast({AXIS.format(s=s)} AS int)"


REVIEW_EXPRS = [
    "doc_id AS artifact_id", "cast(r AS bigint) AS reviewer_id",
    f"{_axis(1)} AS semantic", f"{_axis(2)} AS structural",
    f"{_axis(3)} AS syntactic", f"{_axis(4)} AS coherence",
    "CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 6 END AS score_scale",
]
BIG_EXPRS = [
    "o_orderkey AS artifact_id",
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'class' WHEN '2' THEN 'object' "
    "WHEN '3' THEN 'component' ELSE 'package' END AS diagram_type",
    "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'pending' END AS render_status",
    "least(6.0, greatest(0.0, o_totalprice / 83333.34)) AS composite_score",
    "o_totalprice / 83333.34 >= 3.5 AS majority_accepted",
    "o_totalprice / 83333.34 >= 3.5 AND o_orderstatus = 'O' AS dataset_accepted",
    "cast(o_custkey AS bigint) AS job_id",
    "CASE o_orderkey % 6 WHEN 0 THEN '@startuml\n@enduml' "
    "WHEN 1 THEN concat('@startuml\npackage P', cast(o_custkey AS string), ' {\n  class A\n}\n@enduml') "
    "WHEN 2 THEN concat('@startuml\npackage P', cast(o_custkey AS string), ' {\n@enduml') "
    "WHEN 3 THEN concat('@startuml\ncore ..> core', cast(o_custkey AS string), '\nlib --> lib\n@enduml') "
    "WHEN 4 THEN concat('@startuml\nclass K', cast(o_custkey AS string), '\n  class B {\n}\n@enduml') "
    "ELSE concat('@startuml\npackage Q', cast(o_custkey AS string), ' {\n  class C\n}\nA ..> B\n@enduml') END AS plantuml_code",
    "CASE o_orderkey % 7 WHEN 0 THEN 'Diagram body is empty or incomplete' "
    "WHEN 1 THEN 'Self-referential dependency: a' WHEN 2 THEN 'Unknown arrow' END AS validation_messages",
]
REPAIR_EXPRS = [
    "l_orderkey AS artifact_id", "l_linenumber AS attempt_number",
    "l_returnflag <> 'R' AS success", "l_partkey", "l_suppkey", "l_extendedprice",
    "CASE WHEN l_returnflag = 'R' THEN 'syntax error near line' END AS reason",
]
RENDER_EXPRS = [
    "l_orderkey AS artifact_id", "l_linenumber AS attempt_number",
    "l_linestatus = 'O' AS success", "l_partkey", "l_suppkey", "l_extendedprice",
    "CASE WHEN l_linestatus <> 'O' THEN CASE WHEN l_partkey % 2 = 0 THEN 'Error line 2' "
    "ELSE 'blank image' END END AS error_output",
]
JOB_EXPRS = [
    "o_orderkey AS job_id",
    "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END AS status",
    "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS updated_at",
    "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS created_at",
    "CASE o_orderkey % 3 WHEN 0 THEN 'earlier error' WHEN 1 THEN '' END AS error",
]
OUTCOME_EXPRS = [
    "event_id", "'strategies' AS kind", "cast(user_id % 4 AS string) AS key",
    "event_type AS name", "value >= 30 AS ok", "ts AS at",
]
GENERATOR_EXPRS = [
    "'generators' AS kind",
    "CASE user_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'object' WHEN 2 THEN 'component' "
    "ELSE 'package' END AS key",
    "CASE WHEN event_type IN ('view', 'click') THEN 'lora' ELSE 'spec-builder' END AS name",
    "value >= CASE WHEN event_type IN ('view', 'click') THEN 10 * (user_id % 4) ELSE 5 END AS ok",
]
STRATEGY_EXPRS = [
    "'strategies' AS kind",
    "concat(CASE user_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'object' WHEN 2 THEN 'component' ELSE 'package' END, '|', "
    "CASE user_id % 3 WHEN 0 THEN 'syntax' WHEN 1 THEN 'missing_element' ELSE 'semantic_alignment' END) AS key",
    "CASE event_type WHEN 'view' THEN 'sanitize_syntax' WHEN 'click' THEN 'spec_rebuild' WHEN 'error' THEN 'llm_targeted' "
    "WHEN 'purchase' THEN 'inject_missing' ELSE 'strip_hallucinations' END AS name",
    "value >= 10 + user_id % 5 AS ok",
]
CORPUS_EXPRS = [
    "doc_id AS ordinal", f"{TYPE_OF_LANG} AS diagram_type",
    "CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'source_code' ELSE 'requirement' END END AS input_mode",
    "CASE doc_id % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 2 THEN 'c' END AS source_language",
    "text AS uml_code", "text AS technical_spec", "source AS source_dataset",
    "doc_id % 5 = 0 AS dataset_accepted", "doc_id % 4 = 0 AS majority_accepted",
]

# diagram texts: one template per variant, over every word of eight letters or more -----------
WORDS = 8
DECLARED = {
    0: "class %A {\n  +id: int\n  +load()\n}",
    1: "package %A {\n  class %ACore\n}",
    2: "package %A {\n  class %ACore\n}",
    3: "class %A",
    5: "class %A;",
    6: "class %A {\n  +id: int\n}",
    8: "object \"%A1\" as %A1 {\n  id = 1\n}",
    9: "component [%AService]",
    10: ":Step %A;",
    11: "participant %A",
}
RELATED = {
    0: ["%A <|-- %B", "%A --> %B : uses", "%A *-- %B"],
    1: ["%A ..> %B", "%A --> %B : integrates", "%A ..> %B : depends"],
    2: ["%A ..> %B", "%A --> %B", "%A ..> %A"],
    3: ["%A --|> %B", "core ..> core", "%A o-- %B"],
    5: ["%A --inheritance--> %B;", "%A -- uses --> %B", "skinparam backgroundColor #FF00AA"],
    6: ["%A ..|> %B", "%A --> %B", "%A -> %B"],
    8: ["%A1 --> %B1 : link", "%A1 --> %B1 : tracks", "%A1 ..> %B1"],
    9: ["[%AService] --> [%BService] : calls", "[%AService] ..> [%BService] : orchestrates", "interface I%A"],
    10: ["if (%A valid?) then (yes)\n  :Process %B;\nendif", ":Notify %B;", ":Check %A --> %B"],
    11: ["%A -> %B : call", "%A --> %B : answer", "' remark %A"],
}
HEAD = {2: "package Broken {\n", 5: "!include secret.iuml\nskinparam shadowing false\n", 10: "start\n"}
TAIL = {5: "\nskinparam shadowing false\nclass Extra <<x>> #Yellow", 10: "\nstop"}
PLAIN = {
    4: "@startuml\n@enduml",
    7: "@startuml\nclass Module1\nclass Module2\nclass Entity\nModule1 --> Module2\n@enduml",
}
FENCE_OPEN = "<think>plan the classes</think>\n```plantuml\n"
FENCE_CLOSE = "\n```"


def _fill(template: str, **names: str) -> str:
    """A template as a SQL concat over the named expressions."""
    parts, rest = [], template
    while rest:
        at = rest.find("%")
        if at < 0:
            parts.append("'" + rest.replace("'", "''") + "'")
            break
        if at:
            parts.append("'" + rest[:at].replace("'", "''") + "'")
        parts.append(names[rest[at + 1]])
        rest = rest[at + 2:]
    return f"concat({', '.join(parts)})" if parts else "''"


def _each(duck: bool, source: str, body: str) -> str:
    if duck:
        return f"list_transform({source}, lambda x, i: {body})"
    return f"transform({source}, (x, i) -> {body})"


def _join(duck: bool, array: str, sep: str = "\n") -> str:
    return f"array_to_string({array}, '{sep}')" if duck else f"array_join({array}, '{sep}')"


def _pairs(duck: bool) -> tuple[str, str, str]:
    """(list of left ends, right end of the pair, zero-based index)."""
    if duck:
        return "n[1:len(n) - 1]", "n[i + 1]", "(i - 1)"
    return "slice(n, 1, greatest(size(n) - 1, 0))", "element_at(n, i + 2)", "i"


def names_expr(duck: bool) -> str:
    if duck:
        words = f"list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{{{WORDS},}}')))"
        return f"list_transform({words}, lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2)))"
    words = f"sort_array(array_distinct(regexp_extract_all(lower(text), '([a-z]{{{WORDS},}})', 1)))"
    return f"transform({words}, x -> concat(upper(substr(x, 1, 1)), substr(x, 2)))"


def code_expr(duck: bool) -> str:
    left, right, index = _pairs(duck)
    arms = []
    for v in range(12):
        if v in PLAIN:
            arms.append(f"WHEN {v} THEN '{PLAIN[v]}'")
            continue
        decl = _join(duck, _each(duck, "n", _fill(DECLARED[v], A="x")))
        rel = " ".join(
            f"WHEN {k} THEN {_fill(t, A='x', B=right)}" for k, t in enumerate(RELATED[v])
        )
        rels = _join(duck, _each(duck, left, f"CASE {index} % 3 {rel} END"))
        open_, close = ("", "") if v != 6 else (FENCE_OPEN, FENCE_CLOSE)
        repeat = f", '\n', {rels}" if v == 5 else ""
        arms.append(
            f"WHEN {v} THEN concat('{open_}@startuml\n{HEAD.get(v, '')}', {decl}, '\n', {rels}{repeat}, "
            f"'{TAIL.get(v, '')}\n@enduml{close}')"
        )
    return f"CASE doc_id % 12 {' '.join(arms)} END"


def spec_names_expr(duck: bool) -> str:
    if duck:
        every = "list_filter(n, lambda x, i: (i - 1) % 2 = 0)"
        index = "(i - 1)"
    else:
        every = "filter(n, (x, i) -> i % 2 = 0)"
        index = "i"
    return _each(duck, every, f"CASE WHEN {index} % 4 = 3 THEN concat(x, 'Xq') ELSE x END")


def spec_expr(duck: bool) -> str:
    """JSON text of the specification; some rows broken, some fenced, some chatty."""
    left, right, index = _pairs(duck)
    entities = _join(duck, _each(duck, "n", _fill('{"name":"%A"}', A="x")), ",")
    kinds = "CASE {i} % 3 WHEN 0 THEN 'inheritance' WHEN 1 THEN 'Association' ELSE 'other' END".format(i=index)
    rels = _join(
        duck,
        _each(duck, left, _fill('{"source":"%A","target":"%B","type":"%K"}', A="x", B=right, K=kinds)),
        ",",
    )
    kind = f"({TYPE_OF_LANG})"
    whole = (
        f"concat('{{\"diagram_type\":\"', {kind}, '\",\"summary\":\"', "
        "CASE WHEN doc_id % 5 <> 0 THEN 'model' ELSE ' ' END, '\",\"entities\":[', "
        "CASE doc_id % 17 WHEN 2 THEN '' WHEN 3 THEN '{\"name\":\" \"}' "
        f"ELSE {entities} END, ']', "
        "CASE WHEN doc_id % 17 = 1 THEN '' ELSE concat(',\"relationships\":[', "
        f"CASE WHEN doc_id % 17 = 4 THEN '' ELSE {rels} END, ']') END, '}}')"
    )
    return (
        f"CASE WHEN doc_id % 17 = 0 THEN '{{\"entities\": [' "
        f"WHEN doc_id % 3 = 0 THEN concat('```json\n', {whole}, '\n```') "
        f"WHEN doc_id % 3 = 1 THEN concat('Here is the plan: ', {whole}, ' Done.') ELSE {whole} END"
    )


SOURCE_TEXT = {
    0: ("package com.demo;\n", "public class %A {\n  private int id;\n  public void load() {}\n}", "public class %B extends %A {\n}"),
    1: ("# script\nimport os\n", "class %A:\n    def load(self):\n        return True\n", "class %B(%A):\n    def check(self):\n        pass\n"),
    2: ("#include <stdio.h>\n", "typedef struct %A {\n    int id;\n} %A;", "void %A_load(%A* self) { }"),
    3: ("", "class %A {\n  load() { return true; }\n}", "const link%A = (x) => %B;"),
    4: ("package demo\n", "type %A struct {}", "func (a *%A) Load() bool { return true }"),
    5: ("", "The %A keeps a list of %A records.", "%A manages %B"),
}


def source_expr(duck: bool) -> str:
    left, right, _ = _pairs(duck)
    arms = []
    for v, (head, decl, link) in SOURCE_TEXT.items():
        body = _join(duck, _each(duck, "n", _fill(decl, A="x")))
        links = _join(duck, _each(duck, left, _fill(link, A="x", B=right)))
        arms.append(f"WHEN {v} THEN concat('{head}', {body}, '\n', {links}, '\n')")
    return f"CASE doc_id % 6 {' '.join(arms)} END"


REPLY_EXPR = (
    "CASE doc_id % 9 "
    "WHEN 0 THEN concat('SCORE: ', {n}, '\nEXPLANATION: ', text) "
    "WHEN 1 THEN concat('**SCORE:** ', {n}, '/6\n', text) "
    "WHEN 2 THEN concat('SEMANTIC: ', {n}, '\nSTRUCTURAL: ', {m}, '\nSYNTACTIC: 5\nCOHERENCE: 2\nEXPLANATION: ', text) "
    "WHEN 3 THEN concat('The diagram is rated ', {n}, ' out of 6. ', text) "
    "WHEN 4 THEN concat('SCORE: <0-6>\n', text) "
    "WHEN 5 THEN concat('Scores about ', {n}, ' here. ', text) "
    "WHEN 6 THEN concat('OVERALL SCORE - ', {m}, '\nRATING: ', {n}, '\n', text) "
    "WHEN 7 THEN concat('SEMANTIC: ', {n}, '\n', text) "
    "ELSE concat('EXPLANATION: ', text, '\nSCORE: ', {n}) END AS reply"
).format(n="cast(doc_id * 3 % 7 AS string)", m="cast(doc_id * 5 % 7 AS string)")

REQUIREMENT_EXPR = (
    "concat(CASE doc_id % 5 WHEN 0 THEN 'Build a bookstore with customers, invoices and shipments. Members can browse products. ' "
    "WHEN 1 THEN 'Classes Book, Member, and Librarian. Member borrows a Book through a Loan. ' "
    "WHEN 2 THEN 'Scheduling for patients, doctors and clinic rooms. Doctor manages Patients. Nurse inherits from Doctor. ' "
    "WHEN 3 THEN 'OrderService depends on PaymentGateway. shopping cart ' ELSE '' END, text) AS requirement"
)


def _select(exprs: list[str], source: str) -> str:
    return f"SELECT {', '.join(exprs)} FROM {source}"


_MODELS = "(VALUES (1, 'qwen25vl3b', 53.1e0), (2, 'llama32vl11b', 50.7e0), (3, 'aya_vision_8b', 39.9e0)) m(i, model_key, weight)"

#: view name -> (views it reads, SQL)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "artifacts": ([], _select(ARTIFACT_EXPRS, "documents")),
    "model_scores": ([], _select(SCORE_EXPRS, f"documents CROSS JOIN {_MODELS}")),
    "human_reviews": ([], _select(REVIEW_EXPRS, "labels CROSS JOIN (VALUES (1), (2), (3)) v(r)")),
    "verdicts": (
        ["model_scores", "artifacts"],
        "SELECT artifact_id, CASE WHEN render_ok THEN coalesce(num / den, 0.0) ELSE 0.0 END AS composite_score, "
        "CASE WHEN render_ok THEN votes ELSE 0 END AS affirmative_votes, "
        "render_ok AND votes >= 2 AS majority_accepted, "
        "render_ok AND votes >= 2 AND coalesce(num / den, 0.0) >= 3.0 AS dataset_accepted FROM ("
        "SELECT a.artifact_id, any_value(render_ok) AS render_ok, sum(weight * score) AS num, "
        "nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) AS den, "
        "count(*) FILTER (WHERE score >= 4) AS votes "
        "FROM artifacts a JOIN model_scores s ON a.artifact_id = s.artifact_id GROUP BY a.artifact_id)",
    ),
    "scored": (
        ["artifacts", "verdicts"],
        "SELECT * FROM artifacts JOIN verdicts USING (artifact_id)",
    ),
    "big_artifacts": ([], _select(BIG_EXPRS, "orders")),
    "repair_attempts": ([], _select(REPAIR_EXPRS, "lineitem")),
    "render_attempts": ([], _select(RENDER_EXPRS, "lineitem")),
    "jobs": ([], _select(JOB_EXPRS, "orders")),
    "outcomes": ([], _select(OUTCOME_EXPRS, "events")),
    "generator_outcomes": ([], _select(GENERATOR_EXPRS, "events")),
    "strategy_outcomes": ([], _select(STRATEGY_EXPRS, "events")),
    "corpus_a": ([], _select(CORPUS_EXPRS, "documents") + " WHERE doc_id % 3 <> 2"),
    "corpus_b": ([], _select(CORPUS_EXPRS, "documents") + " WHERE doc_id % 3 <> 1"),
    "corpus_c": ([], _select(CORPUS_EXPRS, "documents") + " WHERE doc_id % 2 = 0"),
    "corpus": ([], _select(CORPUS_EXPRS, "documents")),
    "named": ([], f"SELECT doc_id, lang, text, {names_expr(True)} AS n FROM documents"),
    "diagrams": (
        ["named"],
        f"SELECT doc_id AS artifact_id, {TYPE_OF_LANG} AS diagram_type, "
        f"{code_expr(True)} AS plantuml_code FROM named",
    ),
    "specs": (
        ["named"],
        f"SELECT doc_id AS artifact_id, {TYPE_OF_LANG} AS diagram_type, {spec_expr(True)} AS spec_text "
        f"FROM (SELECT doc_id, lang, {spec_names_expr(True)} AS n FROM named)",
    ),
    "spec_names": (
        ["named"],
        f"SELECT doc_id AS artifact_id, {spec_names_expr(True)} AS n FROM named",
    ),
    "code_sources": (
        ["named"],
        f"SELECT doc_id AS artifact_id, {source_expr(True)} AS code FROM named",
    ),
    "blocks": (["diagrams"], sqltext.BLOCKS),
    "declared": (["blocks"], sqltext.DECLARED),
    "replies": ([], f"SELECT doc_id AS artifact_id, {REPLY_EXPR} FROM documents"),
    "requirements": ([], f"SELECT doc_id AS artifact_id, {REQUIREMENT_EXPR} FROM documents"),
}


def with_views(sql: str, names: list[str]) -> str:
    """``sql`` with the fixture views it reads put in front as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEW_SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql.strip()
    head = ", ".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


class Tables:
    """Lazily built DataFrames over one data folder."""

    #: whether the work on each diagram is far more than that of dealing out its text
    costly = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def for_costly_work(self) -> Tables:
        """The same views, their texts dealt out evenly whatever the files look like."""
        out = Tables(self.spark, self.folder)
        out.costly = True
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        raise AttributeError(name)

    @cached_property
    def texts(self) -> DataFrame:
        """The documents, spread over the cores where they come in fewer tasks."""
        return spread(self.documents, "doc_id")

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.documents.selectExpr(*ARTIFACT_EXPRS)

    @cached_property
    def model_scores(self) -> DataFrame:
        models = F.expr(
            "inline(array(named_struct('i', 1, 'model_key', 'qwen25vl3b', 'weight', 53.1D), "
            "named_struct('i', 2, 'model_key', 'llama32vl11b', 'weight', 50.7D), "
            "named_struct('i', 3, 'model_key', 'aya_vision_8b', 'weight', 39.9D)))"
        )
        return self.documents.select("doc_id", models).selectExpr(*SCORE_EXPRS)

    @cached_property
    def human_reviews(self) -> DataFrame:
        raters = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("r")
        return self.labels.select("*", raters).selectExpr(*REVIEW_EXPRS)

    @cached_property
    def scored(self) -> DataFrame:
        return S.with_verdicts(self.artifacts, self.model_scores)

    @cached_property
    def big_artifacts(self) -> DataFrame:
        return self.orders.selectExpr(*BIG_EXPRS)

    @cached_property
    def repair_attempts(self) -> DataFrame:
        return self.lineitem.selectExpr(*REPAIR_EXPRS)

    @cached_property
    def render_attempts(self) -> DataFrame:
        return self.lineitem.selectExpr(*RENDER_EXPRS)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.orders.selectExpr(*JOB_EXPRS)

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.events.selectExpr(*OUTCOME_EXPRS)

    @cached_property
    def generator_outcomes(self) -> DataFrame:
        return self.events.selectExpr(*GENERATOR_EXPRS)

    @cached_property
    def strategy_outcomes(self) -> DataFrame:
        return self.events.selectExpr(*STRATEGY_EXPRS)

    @cached_property
    def corpus(self) -> DataFrame:
        return self.documents.selectExpr(*CORPUS_EXPRS)

    @cached_property
    def corpus_a(self) -> DataFrame:
        return self.documents.where("doc_id % 3 <> 2").selectExpr(*CORPUS_EXPRS)

    @cached_property
    def corpus_b(self) -> DataFrame:
        return self.documents.where("doc_id % 3 <> 1").selectExpr(*CORPUS_EXPRS)

    @cached_property
    def corpus_c(self) -> DataFrame:
        return self.documents.where("doc_id % 2 = 0").selectExpr(*CORPUS_EXPRS)

    @cached_property
    def named(self) -> DataFrame:
        texts = self.documents.select("doc_id", "lang", "text")
        texts = dealt(texts, "doc_id") if self.costly else spread(texts, "doc_id")
        return hold(texts, {"n": F.expr(names_expr(False))})

    def _text(self, df: DataFrame, name: str, expr: str) -> DataFrame:
        kind = df.selectExpr("doc_id AS artifact_id", f"{TYPE_OF_LANG} AS diagram_type", "doc_id", "n")
        return hold(kind, {name: F.expr(expr)}, ["artifact_id", "diagram_type"])

    @cached_property
    def diagrams(self) -> DataFrame:
        return self._text(self.named, "plantuml_code", code_expr(False))

    @cached_property
    def spec_names(self) -> DataFrame:
        return hold(self.named, {"n": F.expr(spec_names_expr(False))}, ["doc_id", "lang"])

    @cached_property
    def specs(self) -> DataFrame:
        texts = self.spec_names.selectExpr("doc_id AS artifact_id", f"{TYPE_OF_LANG} AS diagram_type", "doc_id", "lang", "n")
        return hold(texts, {"spec_text": F.expr(spec_expr(False))}, ["artifact_id", "diagram_type"])

    @cached_property
    def code_sources(self) -> DataFrame:
        return self._text(self.named, "code", source_expr(False)).drop("diagram_type")

    @cached_property
    def replies(self) -> DataFrame:
        return spread(self.documents, "doc_id").selectExpr("doc_id AS artifact_id", REPLY_EXPR)

    @cached_property
    def requirements(self) -> DataFrame:
        return spread(self.documents, "doc_id").selectExpr("doc_id AS artifact_id", REQUIREMENT_EXPR)
