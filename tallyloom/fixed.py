"""Names, weights, lists and texts whose exact content decides results."""

# --- fixed values: scoring -------------------------------------------------
MODEL_WEIGHTS = {"qwen25vl3b": 53.1, "llama32vl11b": 50.7, "aya_vision_8b": 39.9}
MODEL_KEYS = ["qwen25vl3b", "llama32vl11b", "aya_vision_8b"]
TAU = 4.0
MIN_VOTES = 2
MIN_COMPOSITE = 3.0
MOCK_MARKER = "mock vlm"

# --- fixed values: diagram types -------------------------------------------
APP_TYPES = ["class", "object", "component", "package"]
EXTENDED_TYPES = [
    "class", "object", "component", "package", "flowchart",
    "usecase", "sequence", "state", "deployment",
]
SUBTYPE_MAP = {
    "class": "class", "object": "object", "component": "component", "package": "package",
    "activity": "flowchart", "flowchart": "flowchart", "usecase": "usecase",
    "use_case": "usecase", "sequence": "sequence", "state": "state",
    "deployment": "deployment", "timing": "sequence", "communication": "sequence",
}
HARD_MISMATCH_TYPES = ["usecase", "sequence", "state", "deployment"]

# --- fixed values: languages -----------------------------------------------
LANGUAGE_NAMES = {
    "typescript": "typescript", "javascript": "javascript", "java": "java",
    "python": "python", "c": "c", "c#": "csharp", "go": "go", "c++": "cpp",
    "php": "php", "kotlin": "kotlin", "shell": "shell", "html": "html", "css": "css",
}
FOCUS_LANGS = ["java", "python", "c"]

# --- fixed values: failure labels, failing order ----------------------------
FAILURE_LABELS = [
    "empty_or_incomplete", "missing_package_block", "unbalanced_braces", "self_dependency",
    "invalid_syntax_other", "render_engine_error", "wrong_diagram_type", "unknown",
]

# --- fixed values: repair strategies by failure category ---------------------
DEFAULT_STRATEGIES = {
    "syntax": ["sanitize_syntax", "spec_rebuild", "llm_targeted"],
    "compile": ["sanitize_syntax", "spec_rebuild", "llm_targeted"],
    "uml_structure": ["sanitize_syntax", "spec_rebuild", "llm_targeted"],
    "missing_element": ["inject_missing", "spec_rebuild", "llm_targeted"],
    "hallucinated_entity": ["strip_hallucinations", "spec_rebuild"],
    "wrong_relationship": ["fix_relationships", "spec_rebuild"],
    "package_hierarchy": ["fix_package_hierarchy", "spec_rebuild"],
    "render": ["sanitize_syntax", "spec_rebuild"],
    "semantic_alignment": ["spec_rebuild", "inject_missing", "strip_hallucinations"],
}
FALLBACK_STRATEGIES = ["spec_rebuild", "sanitize_syntax"]
MIN_SAMPLES_TO_ADAPT = 3

# --- fixed values: published figures by type ---------------------------------
PUBLISHED_BY_TYPE = [
    ("class", 95.7, 4.31, 0.74, 87, 0.82, 0.74),
    ("object", 94.4, 4.09, 0.81, 112, 0.76, 0.71),
    ("component", 91.6, 3.87, 0.93, 169, 0.68, 0.65),
    ("package", 81.1, 3.12, 1.04, 379, 0.55, 0.58),
]

# --- fixed values: corpus columns ---------------------------------------------
CORE_COLUMNS = [
    "diagram_type", "input_mode", "source_language", "source_requirement", "technical_spec",
    "uml_code", "dataset_accepted", "majority_accepted", "source_dataset", "merge_source",
]

# --- fixed values: spec rules --------------------------------------------------
SPEC_REQUIRED_FIELDS = ["diagram_type", "entities", "relationships"]
SPEC_RELATION_TYPES = [
    "association", "aggregation", "composition", "inheritance", "dependency",
    "containment", "realization", "link", "uses",
]

# --- fixed values: names that say nothing ---------------------------------------
GENERIC_NAME_PATTERN = r"(?i)^(Module|Entity|Component|Package|Class|Object)\d*$"
GENERIC_CLASS_NAMES = [
    "entity", "entities", "detected", "language", "unknown", "model", "class",
    "process", "module", "module1", "module2",
]
ALLOWED_EXTRA_NAMES = [
    "abc", "object", "component", "package", "interface", "enum", "note", "title",
    "start", "stop", "driverscript",
]

# --- fixed values: worded arrows --------------------------------------------------
ARROW_WORDS = {
    "inheritance": "--|>", "inherits": "--|>", "extends": "--|>", "generalization": "--|>",
    "association": "-->", "associates": "-->", "link": "-->",
    "composition": "*--", "composes": "*--", "aggregation": "o--", "aggregates": "o--",
    "dependency": "..>", "depends": "..>", "uses": "..>",
    "realization": "..|>", "realizes": "..|>", "containment": "+--", "contains": "+--",
}
RELATION_TOKENS = ["<|--", "--|>", "*--", "o--", "<|..", "..|>", "..>", "-->", "->"]

# --- fixed values: prose mining stop words ------------------------------------------
STOP_ENTITIES = [
    "the", "and", "for", "with", "from", "that", "this", "your", "system", "software",
    "class", "classes", "object", "component", "package", "diagram", "uml", "json",
    "service", "services", "module", "modules", "using", "through", "into", "via",
    "must", "should", "shall", "will", "have", "has", "been", "being", "also",
    "build", "create", "manage", "management", "application", "platform", "model",
    "design", "implement", "develop", "provide", "online", "mobile", "smart",
    "simple", "multiple", "across", "based", "like", "just", "make", "made",
    "tool", "hub", "board", "site", "app", "portal", "dashboard", "network",
    "catalog", "tracker", "workflow", "workflows", "flow", "phase",
]
PHRASE_STOP_EXTRA = ["an", "a", "of", "in", "on", "to", "or", "as", "by", "its", "their"]
REJECTED_CONCEPTS = [
    "svc", "api", "store", "repo", "alice", "bob", "carol", "dave", "main",
    "ecommerce", "banking", "hospital", "library", "checkout", "online",
]
REJECTED_KINDS = ["service", "services", "component", "components", "package", "packages"]

# --- fixed values: prompt texts --------------------------------------------------------
SOURCE_PROMPT_TAIL = (
    "from this codebase. Use a title, a DiagramGuide note in plain English, labeled relationships, "
    "and a legend so anyone on the team can track the software design."
)
REQUIREMENT_PROMPT_TAIL = (
    "diagram. Include a title, a short note (note as DiagramGuide) explaining the picture in "
    "everyday language, English labels on every arrow, and a legend of symbols. The diagram is "
    "used to keep track of software design through the development lifecycle."
)
TRUNCATED_MARK = "\n...[truncated]"
LONG_TRUNCATED_MARK = "\n...[truncated for model length]..."
MIDDLE_TRUNCATED_MARK = (
    "\n\n...[middle truncated for model length; full text still used for grounding]...\n\n"
)

# --- fixed values: style header put after the opening tag --------------------------------
PUBLICATION_STYLE = [
    "skinparam monochrome true", "skinparam shadowing false", "skinparam backgroundColor white",
    "skinparam defaultFontColor black", "skinparam ArrowColor black",
    "skinparam ClassBorderColor black", "skinparam PackageBorderColor black",
    "skinparam ComponentBorderColor black", "skinparam ObjectBorderColor black",
    "skinparam NoteBorderColor black", "skinparam dpi 150",
]

# --- fixed values: synthetic domains and their entities -------------------------------------
DOMAIN_ENTITIES = {
    "ecommerce": ["Customer", "Order", "Product", "Cart", "Payment", "Shipment"],
    "hospital": ["Patient", "Doctor", "Appointment", "Clinic", "Prescription", "Lab"],
    "banking": ["Account", "Customer", "Transaction", "Loan", "Card", "Branch"],
    "education": ["Student", "Course", "Instructor", "Enrollment", "Assignment", "Grade"],
    "logistics": ["Shipment", "Warehouse", "Carrier", "Route", "Package", "Hub"],
    "iot": ["Device", "Sensor", "Gateway", "Telemetry", "Alert", "Firmware"],
    "social": ["User", "Post", "Comment", "Follow", "Feed", "Notification"],
    "hr": ["Employee", "Department", "Payroll", "Leave", "Role", "Review"],
    "inventory": ["Item", "Sku", "Warehouse", "Supplier", "Stock", "Reorder"],
    "booking": ["Guest", "Room", "Reservation", "Hotel", "Payment", "Invoice"],
    "insurance": ["Policy", "Claim", "Customer", "Agent", "Premium", "Coverage"],
    "telecom": ["Subscriber", "Plan", "Sim", "Usage", "Invoice", "Tower"],
    "library": ["Member", "Book", "Loan", "Catalog", "Librarian", "Fine"],
    "restaurant": ["Customer", "MenuItem", "Order", "Table", "Chef", "Bill"],
    "fleet": ["Vehicle", "Driver", "Trip", "Maintenance", "Depot", "FuelLog"],
    "energy": ["Meter", "Customer", "Tariff", "Reading", "Outage", "GridNode"],
    "media": ["Viewer", "Content", "Channel", "Subscription", "Ad", "Playlist"],
    "gaming": ["Player", "Match", "Inventory", "Quest", "Guild", "Score"],
    "crm": ["Lead", "Contact", "Opportunity", "Account", "Activity", "Campaign"],
    "ticketing": ["Ticket", "Requester", "Agent", "Queue", "Sla", "Comment"],
}
SYNTHETIC_TYPES = ["class", "object", "component", "package", "flowchart"]

# --- fixed values: scenario sentences by human language; %D domain, %A %B %C entities --------
SCENARIO_TEMPLATES = [
    ("en", "Build a %D system where %A interacts with %B and %C."),
    ("en", "The %D platform must manage %A, %B, and %C with clear relationships."),
    ("es", "Sistema de %D: %A se relaciona con %B y %C."),
    ("fr", "Le système %D gère %A, %B et %C."),
    ("de", "Das %D-System verbindet %A, %B und %C."),
    ("hi", "%D प्रणाली में %A, %B और %C हों।"),
    ("zh", "%D系统需要%A、%B和%C。"),
    ("pt", "O sistema de %D inclui %A, %B e %C."),
    ("it", "Il sistema %D collega %A, %B e %C."),
    ("ja", "%Dシステムは%A、%B、%Cを管理する。"),
    ("ko", "%D 시스템은 %A, %B, %C를 관리한다."),
    ("ar", "نظام %D يشمل %A و %B و %C."),
    ("ru", "Система %D связывает %A, %B и %C."),
    ("nl", "Het %D-systeem beheert %A, %B en %C."),
    ("tr", "%D sistemi %A, %B ve %C içerir."),
    ("pl", "System %D łączy %A, %B i %C."),
    ("sv", "%D-systemet hanterar %A, %B och %C."),
    ("vi", "Hệ thống %D gồm %A, %B và %C."),
    ("th", "ระบบ %D มี %A %B และ %C"),
    ("id", "Sistem %D mengelola %A, %B, dan %C."),
]
# --- fixed values: source texts by code language; %A %B %C types, %m %n methods, %M %N in capitals ---
CODE_TEMPLATES = [
    ("python", "class %A:\n    def %m(self):\n        return True\n\nclass %B(%A):\n    def %n(self):\n        pass\n\nclass %C:\n    def link(self, other: '%B'):\n        self.ref = other\n"),
    ("java", "package demo;\npublic class %A {\n  public void %m() {}\n}\npublic class %B extends %A {\n  public void %n() {}\n}\npublic class %C {\n  private %B ref;\n}\n"),
    ("c", "#include <stdio.h>\n#include <stdlib.h>\n\ntypedef struct %A {\n    int id;\n    char name[64];\n} %A;\n\ntypedef struct %B {\n    %A base;\n    void (*%n)(struct %B*);\n} %B;\n\ntypedef struct %C {\n    %B* ref;\n    int linked;\n} %C;\n\nvoid %m_%A(%A* self) {\n    if (self) self->id = 0;\n}\n"),
    ("javascript", "class %A {\n  %m() { return true; }\n}\nclass %B extends %A {\n  %n() {}\n}\nclass %C {\n  constructor(ref) { this.ref = ref; }\n}\n"),
    ("typescript", "export class %A {\n  %m(): boolean { return true; }\n}\nexport class %B extends %A {\n  %n(): void {}\n}\nexport class %C {\n  constructor(public ref: %B) {}\n}\n"),
    ("rust", "struct %A {}\nimpl %A {\n  fn %m(&self) -> bool { true }\n}\nstruct %B { parent: %A }\nimpl %B {\n  fn %n(&self) {}\n}\nstruct %C { ref: %B }\n"),
    ("go", "package demo\ntype %A struct{}\nfunc (a *%A) %M() bool { return true }\ntype %B struct{ %A }\nfunc (b *%B) %N() {}\ntype %C struct{ Ref *%B }\n"),
    ("csharp", "namespace Demo {\npublic class %A { public void %M() {} }\npublic class %B : %A { public void %N() {} }\npublic class %C { public %B Ref { get; set; } }\n}\n"),
    ("kotlin", "open class %A { fun %m(): Boolean = true }\nclass %B : %A() { fun %n() {} }\nclass %C(val ref: %B)\n"),
    ("swift", "class %A { func %m() -> Bool { return true } }\nclass %B: %A { func %n() {} }\nclass %C { var ref: %B? }\n"),
    ("cpp", "class %A { public: void %m(); };\nclass %B : public %A { public: void %n(); };\nclass %C { %B* ref; };\n"),
    ("c", "#include <stdio.h>\n#include <stdlib.h>\n\ntypedef struct %A {\n    int id;\n    char name[64];\n} %A;\n\ntypedef struct %B {\n    %A base;\n    double value;\n} %B;\n\ntypedef struct %C {\n    %B* ref;\n    int count;\n} %C;\n\nvoid %m(%A* self) { self->id = 1; }\nint %n(%B* self) { return self ? (int)self->value : 0; }\n"),
    ("ruby", "class %A\n  def %m; true; end\nend\nclass %B < %A\n  def %n; end\nend\nclass %C\n  attr_accessor :ref\nend\n"),
    ("php", "<?php\nclass %A { public function %m() { return true; } }\nclass %B extends %A { public function %n() {} }\nclass %C { public $%B $ref; }\n"),
    ("scala", "class %A { def %m(): Boolean = true }\nclass %B extends %A { def %n(): Unit = () }\nclass %C(val ref: %B)\n"),
    ("dart", "class %A { bool %m() => true; }\nclass %B extends %A { void %n() {} }\nclass %C { %B? ref; }\n"),
    ("perl", "package %A; sub %m { 1 }\npackage %B; use parent '%A'; sub %n {}\npackage %C; sub new { bless {}, shift }\n"),
    ("lua", "%A = {}\nfunction %A:%m() return true end\n%B = setmetatable({}, {__index=%A})\nfunction %B:%n() end\n%C = { ref = nil }\n"),
    ("r", "%A <- setRefClass('%A', methods = list(%m = function() TRUE))\n%B <- setRefClass('%B', contains = '%A', methods = list(%n = function() NULL))\n"),
    ("matlab", "classdef %A\n  methods\n    function r = %m(obj), r = true; end\n  end\nend\n"),
    ("haskell", "data %A = %A\n%m :: %A -> Bool\n%m _ = True\ndata %B = %B %A\ndata %C = %C %B\n"),
    ("elixir", "defmodule %A do\n  def %m(), do: true\nend\ndefmodule %B do\n  def %n(), do: :ok\nend\n"),
]
WITHOUT_OBJECTS = ["haskell", "r", "matlab"]
