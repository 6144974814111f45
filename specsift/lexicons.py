"""Word lists, tables and patterns that results depend on. Fixed values throughout."""

from __future__ import annotations

#: Vague terms in scan order: term, severity.
VAGUE_TERMS = (
    ("quickly", "high"), ("fast", "high"), ("immediately", "high"), ("real-time", "high"), ("large number", "high"), ("scalable", "high"), ("user-friendly", "high"), ("intuitive", "high"),
    ("appropriate", "medium"), ("as needed", "medium"), ("if necessary", "medium"), ("adequate", "medium"), ("sufficient", "medium"), ("reasonable", "medium"), ("easy to", "medium"), ("easily", "medium"),
    ("simple", "medium"), ("flexible", "medium"), ("robust", "medium"), ("seamless", "medium"), ("efficient", "medium"),
    ("etc.", "low"), ("e.g.", "low"), ("and/or", "low"), ("some", "low"), ("various", "low"), ("several", "low"), ("many", "low"),
)
WEAK_VERBS = ("should", "may", "could")
#: Why a term is ambiguous and what to write instead, in scan order.
ADVICE = {
    "quickly": ("No measurable time constraint defined", "within [X] milliseconds/seconds"),
    "fast": ("No measurable performance target defined", "with response time under [X]ms at the 95th percentile"),
    "immediately": ("No specific time bound — 'immediately' is subjective", "within [X] seconds of the triggering event"),
    "real-time": ("No latency bound defined for 'real-time'", "with updates pushed within [X] seconds"),
    "large number": ("No specific quantity defined", "[specify exact count, e.g., 10,000 concurrent users]"),
    "scalable": ("No scaling dimensions or limits defined", "supporting [X] to [Y] concurrent users with horizontal scaling"),
    "user-friendly": ("Subjective usability claim without measurable criteria", "compliant with WCAG 2.1 AA, completable in [X] steps"),
    "intuitive": ("Subjective UX claim — not testable", "new users complete [task] without training within [X] minutes"),
    "appropriate": ("No criteria defining what 'appropriate' means", "[define specific validation rules or criteria]"),
    "as needed": ("Trigger condition is undefined", "when [specific trigger condition occurs]"),
    "if necessary": ("Decision criteria for necessity undefined", "when [specific condition] is met"),
    "adequate": ("No measurable threshold for adequacy", "meeting [specific threshold or standard]"),
    "sufficient": ("No quantitative sufficiency criteria", "at least [X] [units]"),
    "reasonable": ("Subjective term without defined bounds", "within [X] to [Y] [units]"),
    "easy to": ("Subjective ease-of-use claim", "completable in [X] steps or [Y] seconds"),
    "easily": ("Subjective ease-of-use claim", "in [X] steps or fewer"),
    "simple": ("Subjective complexity claim — not testable", "using a single [action/screen/step]"),
    "flexible": ("No specific flexibility dimensions defined", "supporting [list specific configuration options]"),
    "robust": ("No specific reliability/resilience criteria", "with [X]% uptime and automatic recovery from [failure types]"),
    "seamless": ("Subjective integration/UX claim", "without requiring user re-authentication or data re-entry"),
    "efficient": ("No measurable efficiency target", "completing [task] in under [X] seconds using [Y] resources"),
    "etc.": ("Incomplete list — all items should be explicitly stated", "[list all remaining items explicitly]"),
    "e.g.": ("Example given but exhaustive list may be needed", "[confirm if this is exhaustive or provide complete list]"),
    "and/or": ("Ambiguous conjunction — unclear if both or either", "specify: 'A and B' or 'A or B' or 'A, B, or both'"),
    "some": ("Vague quantifier", "[specify exact count or percentage]"),
    "various": ("Vague quantifier — items not enumerated", "[list all specific items]"),
    "several": ("Vague quantifier", "[specify exact count]"),
    "many": ("Vague quantifier", "[specify exact count or range]"),
    "should": ("'Should' implies optional — use 'shall' for mandatory requirements", "Replace 'should' with 'shall' if this is mandatory"),
    "may": ("'May' implies optional permission — is this required?", "Replace 'may' with 'shall' if mandatory, or clarify as optional"),
    "could": ("'Could' implies possibility, not requirement", "Replace 'could' with 'shall' if this is a requirement"),
}
NEGATIONS = ("not", "no", "never", "deny", "reject", "block", "restrict", "detain", "prohibit", "prevent", "absent", "fail", "cannot", "unauthorized", "prohibited", "restricted")
CONTEXT_STOP = ("shall", "must", "will", "should", "system", "user", "permit", "allow", "authorize", "grant", "prohibit", "detain", "block", "deny", "reject", "restrict", "prevent")
#: Groups of words for one concept; the first of a group stands for it.
CONCEPTS = (
    ("access", ("permission", "access", "action", "operation", "request", "override")),
    ("login", ("login", "authentication", "sign-in")),
    ("attendance", ("attendance", "presence", "absence", "leave")),
)
VERB_CLASSES = {
    "allow": "permit", "approve": "permit", "enable": "permit", "grant": "permit", "restrict": "deny", "reject": "deny", "block": "deny", "deny": "deny", "detain": "deny",
    "present": "permit", "absent": "deny",
}
OBJECT_BOILERPLATE = (
    "shall", "must", "will", "should", "system", "user", "automatically", "force", "ensure", "provide", "manage", "handle", "track", "support", "interface", "allow", "permit",
    "prohibit", "restrict", "be", "can", "remain", "valid", "for", "the", "and", "all", "with", "from", "after", "before", "upon", "during", "that", "this", "have", "has", "its",
    "are", "not", "only",
)
ACTOR_ALIASES = (("cr", "Class Representative"), ("class representative", "Class Representative"), ("faculty member", "Faculty"), ("faculty", "Faculty"), ("admin", "Admin"), ("administrator", "Admin"))
CONDITION_UNITS = "days|seconds|minutes|users|percent|ms|hours|transactions"
CONDITION_VARIABLES = "attendance|marks|score|users|cpu|memory|storage|age|time|count|latency|delay|threshold|capacity"
NORMATIVE = ("shall", "must", "should", "will", "needs to", "required to", "if", "when", "where", "whenever")
NOISE = ("introduction", "table of contents", "scope", "purpose", "overview", "page_", "document history", "copyright", "confidential", "preface", "appendix", "glossary", "analysis models")
ERROR_WORDS = ("error", "fail", "invalid", "timeout", "exception", "retry", "fallback", "decline")
AC_MARKERS = ("if ", "when ", "then ", "must ", "shall ")
DOC_TYPES = (
    ("manual", ("bsim", "compact model", "bsimsoi", "user manual", "users manual")), ("thesis", ("thesis", "phd", "dissertation", "acknowledgements")),
    ("roadmap", ("irds", "roadmap", "technology generation", "scaling")), ("lecture_notes", ("lecture", "mit", "course", "homework", "class")),
)
CRITICAL_TOKENS = ("FR", "NFR", "US", "Acceptance Criteria", "shall", "must", "Attendance", "Faculty", "CR")
COMMON_ACTORS = ("admin", "system", "database", "user")
VAGUE_GOAL_VERBS = ("manage", "handle", "process", "do")
GARBAGE_LINES = ("der", "tier", "owe", "cite", "owne", "ouse")

# Patterns of requirement text. Java reads them with (?d), so that only a line feed ends a line.
ID = r"(?i)\b([A-Z]{2,5}(?:-[A-Z]+)?-\d{1,3})\b"
SHORT_ID = r"(?i)(US\d+|FR[- \t\n]?\d+|NFR[- \t\n]?\d+)"
CONDITION = r"(?i)(?:if|when|where)\s+(.*?)(?:,|then|\bsystem\b|\bshall\b)"
ACTION = r"(?i)((?:\b\w+\b\s+){0,5})\b(shall|must|will|should|needs to)\b([^\.]*)"
ROLE = r"(?is)As (?:a|the)\s+(.*?)(?:,|\s+I want to)"
ROLE_WORD = r"(?i)\b(system|admin|user|employee|manager)\b"
LOGIC = r"(?i)(?:if|when|where|during)\s+(.*?)(?:,\s*|\s+then\s+|\s+shall\s+|\s+must\s+|\s+will\s+)(.*?)(?:\.|$)"
GOAL = r"(?is)I want to\s+(.*?)(?:,|\s+so that|$)"
REASON = r"(?is)so that\s+(.*?)(?:\.|\n|$)"

# Patterns of page lines.
PAGE_NUMBER = (r"^\s*\d{1,4}\s*$", r"^\s*-\s*\d+\s*-\s*$", r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$", r"^\s*\d+\s*/\s*\d+\s*$")
REFERENCE = (r"^\s*\[\d+\]\s+\w", r"^\s*\d+\.\s+[A-Z][a-z]+")
REFERENCE_HEAD = r"(?i)^\s*(references|bibliography)\s*$"
TOC = r"^.{5,60}\.{4,}\s*\d+\s*$"
FIGURE = r"(?i)fig(ure|\.)\s*\d+"
PAGE_MARKER = r"<!-- (PAGE_\d+) -->"
MARKDOWN_TABLE = r"(\n\|.*\|\n\|[-:| ]+\|\n(?:\|.*\|\n)+)"
DECORATION = r"^[+\-=\s><|]+$"

# Equation lines.
PROSE = (
    r"(?i)^(The|A|In|For|This|It|When|Where|Note|If|Since|As|We|To)\b", r"(?i)\b(is used|are used|was observed|can be|will be|has been|which results|becomes|shows|such as)\b",
    r"(?i)\b(figure|table|chapter|section|reference|copyright|manual)\b", r"(?i)\b(here|therefore|however|although|because|moreover|furthermore)\b", r"^\d+\.\d+[\.\d]*\s+[A-Z]",
    r"(?i)^Step\s+\d+", r"(?i)^Fitting Target", r"http[s]?://", r"\.{3,}",
)
MATH = (
    r"[=]", r"[/*^√∫∂∑∏∆]", r"\b[A-Z][a-z]*\s*[=<>≤≥≈]\s*", r"\([^)]*[+\-*/=][^)]*\)", r"[²³⁻¹ₙₛₜ₀₁₂₃₄]", r"\bexp\s*\(|\bln\s*\(|\blog\s*\(|\bsqrt\s*\(", r"\d+[eE][+-]?\d+",
)
PHYSICS = "μεφηλρστα"
OPERATORS = "=+-·*/^√"
SUBSCRIPTS = (
    "Vgs", "VGS", "V_GS", "Vth", "VT", "V_th", "Vt", "Id", "I_D", "IDS", "I_d", "Cox", "C_ox", "C_OX", "mueff", "mu_eff", "Vfb", "V_fb", "Vds", "VDS", "Vbs", "VBS", "gm", "gds",
    "Cgs", "Cgd", "NA", "ND",
)
EQUATION_COMMON = (
    "the", "is", "are", "was", "were", "has", "have", "been", "will", "can", "that", "which", "this", "with", "from", "into", "such", "also", "more",
)
EQUATION_PROSE_START = r"(?i)^(The|A|In|For|This|It|When|Note|If|Since|We|To|was|has|are|is)\b"
EQUATION_NUMBER_END = r"\(\d+[\.\-]\d+\)\s*$"
SYMBOLS = {
    "Vgs": "Vgs", "V_GS": "Vgs", "VGS": "Vgs", "V_gs": "Vgs", "Vth": "Vth", "V th": "Vth", "VT": "Vth", "Vt": "Vth", "V_th": "Vth", "Vthr": "Vth", "Id": "Id", "I_D": "Id", "IDS": "Id", "I_d": "Id",
    "I_ds": "Id", "Cox": "Cox", "C_ox": "Cox", "C_OX": "Cox", "mueff": "mu_eff", "μeff": "mu_eff", "mu_eff": "mu_eff", "u_eff": "mu_eff", "phi_f": "phi_f", "φf": "phi_f", "2φF": "phi_f",
    "epsilon_si": "eps_si", "εsi": "eps_si", "eps_si": "eps_si", "NA": "NA", "N_A": "NA", "p-type doping": "NA", "DIBL": "DIBL", "delta_Vth": "DIBL", "Vfb": "Vfb", "V_fb": "Vfb", "VFB": "Vfb",
    "Vds": "Vds", "V_DS": "Vds", "VDS": "Vds", "gm": "gm", "g_m": "gm",
}
ASCII_MATH = (("×", "*"), ("·", "*"), ("÷", "/"), ("−", "-"), ("–", "-"), ("—", "-"), ("²", "**2"), ("³", "**3"), ("½", "(1/2)"), ("¼", "(1/4)"), ("≈", "="), ("≡", "="), ("∝", "~"))
#: LaTeX tokens and their plain forms.
LATEX = {
    r"V_{th}": "Vth", r"V_{th0}": "Vth0", r"V_{gs}": "Vgs", r"V_{ds}": "Vds", r"V_{bs}": "Vbs", r"V_{fb}": "Vfb", r"V_{bi}": "Vbi", r"L_{eff}": "Leff", r"W_{eff}": "Weff", r"C_{ox}": "Cox",
    r"C_{it}": "Cit", r"N_{ch}": "Nch", r"N_{sub}": "Nsub", r"N_{it}": "Nit", "N_A": "NA", r"t_{ox}": "tox", r"t_{oxe}": "toxe", r"nv_{tnom}": "nv_tnom", "nv_t": "nv_t", "v_t": "vt",
    r"\Delta V_{th}": "DeltaVth", r"\Delta": "Delta", r"\delta": "delta", r"\gamma": "gamma_", r"\phi_f": "phi_f", r"\phi_s": "phi_s", r"\Phi_s": "Phi_s", r"\Phi_f": "Phi_f",
    r"\epsilon_{si}": "eps_si", r"\varepsilon_{si}": "eps_si", r"\mu_n": "mu_n", r"\mu_p": "mu_p", r"\mu_{eff}": "mu_eff", r"\approx": "=", r"\to": "_to_", r"\rightarrow": "_to_", r"\cdot": "*",
    r"\times": "*", r"\left": "", r"\right": "", r"\ln": "log", r"\tanh": "tanh", r"\exp": "exp", r"\sqrt": "sqrt",
}

# Diagrams.
SHAPE_SIZES = {
    "uml.Actor": (60, 100), "uml.UseCase": (160, 60), "uml.SystemBoundary": (420, 320), "uml.StartNode": (30, 30), "uml.EndState": (36, 36), "uml.ActionState": (160, 50), "uml.DecisionNode": (100, 60),
    "dfd.Process": (120, 80), "dfd.DataStore": (160, 50), "dfd.ExternalEntity": (120, 60), "standard.Rectangle": (160, 60),
}
ACTIVITY_NODES = ("uml.StartNode", "uml.EndState", "uml.ActionState", "uml.DecisionNode")
