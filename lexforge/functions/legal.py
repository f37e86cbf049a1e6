"""Fixed values of the legal domain, and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import let

# Patterns of boosted terms, in order; words matched without regard to case.
BOOST_PATTERNS = [
    r"\d{4}\s+[A-Z]{2,6}\s+\d+",
    r"\b[Ss]\.?\s*\d+(\.\d+)*",
    r"\b[Ss]ection\s+\d+(\.\d+)*",
    r"\b(?:ESA|OHSA|CLC|SCC|HRC|ESA 2000)\b",
    r"\b[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+",
]
# Terms of employment cases, and tribunals whose cases always count.
EMPLOYMENT_TERMS = [
    "wrongful dismissal", "constructive dismissal", "termination of employment", "reasonable notice", "notice period",
    "severance", "pay in lieu", "employment contract", "employment agreement", "employment standards",
    "employment law", "labour law", "labor law", "labour relations", "labour board", "labor board", "union",
    "collective agreement", "unfair labour practice", "unfair labor practice", "wrongful termination",
    "unjust dismissal", "human rights", "discrimination", "harassment", "workplace harassment", "sexual harassment",
    "poisoned work environment", "reasonable accommodation", "duty to accommodate", "accommodation",
    "undue hardship", "workplace safety", "occupational health", "occupational health and safety",
    "workplace injury", "workers compensation", "worker's compensation", "employee", "employer",
    "independent contractor", "employee misclassification", "worker classification", "employment relationship",
    "employer-employee", "employer and employee", "employment standards act", "esa 2000", "overtime pay",
    "minimum wage", "public holiday", "vacation pay", "statutory holiday", "temporary help", "assignment employee",
    "wages", "termination clause", "enforceable termination", "canada labour code", "labour code", "canada labour",
    "federal employment", "federally regulated", "non-compete", "non-competition", "non-solicit", "non-solicitation",
    "restrictive covenant", "confidential information", "bonus", "stock option", "rsu", "incentive compensation",
    "retirement", "pension", "benefits", "layoff", "furlough", "redundancy", "restructuring",
    "reasonable notice period", "common law notice", "punitive damages", "aggravated damages", "bad faith damages",
    "moral damages", "wallace damages", "wrongful dismissal damages", "mitigation", "duty to mitigate",
    "maternity leave", "parental leave", "family leave", "sick leave", "medical leave", "compassionate care",
    "family status", "caregiver", "employment insurance", "ei benefits", "unemployment", "insurable employment",
    "loss of employment",
]
TRIBUNALS = ["chrt", "cirb", "fpslreb", "ohstc", "sst"]
# Topics by the first rule that matches.
TOPICS = [
    ("Human Rights & Discrimination", ["human right", "discrimination", "harassment"]),
    ("Labour Relations & Unions", ["union", "collective agreement", "labour relation", "certification"]),
    ("Wrongful Dismissal & Termination", ["wrongful dismissal", "constructive dismissal", "termination", "notice"]),
    ("Employment Insurance", ["ei", "employment insurance", "unemployment"]),
    ("Workplace Safety & Compensation", ["worker compensation", "workplace injur", "occupational health"]),
    ("Worker Classification", ["independent contractor", "employee misclassification"]),
    ("Employment Standards", ["employment standard", "esa", "overtime", "minimum wage"]),
    ("Accommodation & Leave", ["accommodation", "family status", "caregiver"]),
    ("Restrictive Covenants", ["non-compete", "non-solicit", "restrictive covenant"]),
]
OTHER_TOPIC = "Employment Law"
# Courts and jurisdictions of dataset codes.
COURTS = {
    "SCC": "Supreme Court of Canada",
    "FC": "Federal Court",
    "FCA": "Federal Court of Appeal",
    "ONCA": "Ontario Court of Appeal",
    "BCCA": "BC Court of Appeal",
    "BCSC": "BC Supreme Court",
    "CHRT": "Canadian Human Rights Tribunal",
    "CIRB": "Canada Industrial Relations Board",
    "FPSLREB": "Federal Public Sector Labour Relations and Employment Board",
    "OHSTC": "Occupational Health and Safety Tribunal Canada",
    "SST": "Social Security Tribunal",
    "NSCA": "Nova Scotia Court of Appeal",
    "CMAC": "Court Martial Appeal Court",
}
JURISDICTIONS = {
    "SCC": "Canada (Federal)", "FC": "Canada (Federal)", "FCA": "Canada (Federal)", "ONCA": "Ontario",
    "BCCA": "British Columbia", "BCSC": "British Columbia", "CHRT": "Canada (Federal)", "CIRB": "Canada (Federal)",
    "FPSLREB": "Canada (Federal)", "OHSTC": "Canada (Federal)", "SST": "Canada (Federal)", "NSCA": "Nova Scotia",
    "CMAC": "Canada (Federal)",
}
# Question intents, the first that matches, and their templates.
INTENTS = [
    ("worker_classification", [
        "employee or independent contractor", "worker classification", "classify", "misclassification", "sagaz",
        "wiebe door", "employment status", "contractor or employee", "independent contractor", "gig worker",
        "dependent contractor",
    ]),
    ("notice_period", [
        "notice period", "reasonable notice", "wrongful dismissal", "termination notice", "bardal", "severance",
        "dismissed without", "terminated without cause", "how much notice", "length of notice",
    ]),
    ("risk_assessment", [
        "risk", "compliance", "penalty", "fine", "liability", "exposure", "regulatory risk", "what happens if",
        "consequences of", "misclassification risk",
    ]),
]
OTHER_INTENT = "general_legal_qa"
# Marks of sections, courts and dates in a text, in order.
SECTIONS = [
    ("facts", r"\b(FACTS?|BACKGROUND|FACTUAL BACKGROUND)\b"),
    ("law", r"\b(LAW|LEGAL FRAMEWORK|APPLICABLE LAW|RELEVANT LAW)\b"),
    ("analysis", r"\b(ANALYSIS|DISCUSSION|REASONING)\b"),
    ("conclusion", r"\b(CONCLUSION|DECISION|ORDER|DISPOSITION)\b"),
    ("issues", r"\b(ISSUES?)\b"),
    ("relief", r"\b(RELIEF|REMEDY|DAMAGES)\b"),
]
COURT_LEVELS = [
    ("supreme", "Supreme Court"), ("appeal", "Court of Appeal"), ("superior", "Superior Court"),
    ("divisional", "Divisional Court"), ("small_claims", "Small Claims"), ("tribunal", "Tribunal"),
]
CITATION = r"\d{4}\s+[A-Z]{2,6}\s+\d+"
DATE = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
# Groups of words that mean the same in the word index.
SYNONYMS = [
    ["employee", "worker", "staff"], ["ic", "freelancer", "self_employed"], ["contractor", "freelancer"],
    ["termination", "dismissal", "firing"], ["esa", "employment_standards_act"], ["clc", "canada_labour_code"],
    ["ohsa", "occupational_health_safety_act"], ["notice_period", "severance", "termination_pay"],
]
# English stop words of the word index.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_of(text: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The name of the first rule of which the lower-cased text contains a phrase."""
    low, name = F.lower(_empty(text)), F.lit(other)
    for label, phrases in reversed(rules):
        hit = F.lit(False)
        for p in phrases:
            hit |= F.contains(low, F.lit(p))
        name = F.when(hit, label).otherwise(name)
    return name


def boost_terms(text: Column) -> Column:
    """Terms to boost, lower-cased, in the order of the patterns and of first sight."""
    every = [F.regexp_extract_all(_empty(text), F.lit(f"(?i){p}"), F.lit(0)) for p in BOOST_PATTERNS]
    return F.array_distinct(F.filter(F.transform(F.concat(*every), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def boosted(content: Column, metadata: list[Column], terms: Column, score: Column, factor: float = 5.0) -> Column:
    """Score times factor where the content or a metadata value holds any of the terms."""
    low = F.lower(F.concat_ws("\n", content, *metadata))
    return F.when(F.exists(terms, lambda t: F.contains(low, t)), score * factor).otherwise(score)


def section_of(text: Column, head: int = 200) -> Column:
    """The section whose mark the head of a chunk holds, null without."""
    name = F.lit(None).cast("string")
    for label, pattern in reversed(SECTIONS):
        name = F.when(F.substring(text, 1, head).rlike(f"(?i){pattern}"), label).otherwise(name)
    return name


def metadata(text: Column) -> Column:
    """citation (the first), citations, decision_date, court_level and sections of a text."""
    t = _empty(text)
    cites = F.regexp_extract_all(t, F.lit(CITATION), F.lit(0))
    level = F.lit(None).cast("string")
    for label, mark in reversed(COURT_LEVELS):
        level = F.when(F.contains(F.lower(t), F.lit(mark.lower())), label).otherwise(level)
    present = F.filter(F.array(*[F.when(t.rlike(f"(?i){p}"), label) for label, p in SECTIONS]), lambda s: s.isNotNull())
    return F.struct(F.get(cites, F.lit(0)).alias("citation"), F.array_distinct(cites).alias("citations"), F.get(F.regexp_extract_all(t, F.lit(DATE), F.lit(0)), F.lit(0)).alias("decision_date"), level.alias("court_level"), present.alias("sections"))


def looked_up(code: Column, names: dict[str, str], other: Column) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), other)


def predicted_class(answer: Column) -> Column:
    low = F.lower(_empty(answer))
    return F.when(F.contains(low, F.lit("independent contractor")), "Independent Contractor").when(F.contains(low, F.lit("employee")), "Employee").otherwise("Unknown")


def follow_ups(answer: Column, most: int = 5) -> Column:
    """Questions of an answer: its lines that end in a question mark, without their numbers, ``most`` at most."""
    lines = F.transform(F.split(_empty(answer), "\n"), lambda s: F.regexp_replace(F.trim(s), r"^(?:\d+[.)]|[-*•])\s*", ""))
    return F.slice(F.filter(lines, lambda s: s.endswith("?")), 1, most)


#: Whole strings, marks, numbers and words of JSON; a string that does not end takes the rest.
JSON_TOKEN = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]+|"[\s\S]*'
JSON_STRING = r'"[^"\\]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\]*+)*+"'
JSON_LITERAL = rf"^(?:{JSON_STRING}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"


def _json_value(answer: Column, opener: str) -> Column:
    """The JSON that begins at the first ``opener`` of an answer, as text with one space after its marks; null where none can be read.

    Fences and prose around it go. Marks, strings and words are folded with a stack of open brackets and what may come
    next, up to the end of the stack or the first token that may not. A text that is cut off keeps what was whole, up to
    the last value, and its brackets are closed; a name without a value goes, so does a word or number cut short of a
    valid one. Brackets within strings are text.
    """
    bare = F.regexp_replace(_empty(answer), r"```(?:json)?", "")
    tokens = F.regexp_extract_all(F.regexp_extract(bare, rf"(?s)(\{opener}.*)", 1), F.lit(JSON_TOKEN), F.lit(0))
    state = "struct<stack:string,next:string,n:int,whole:int,open:string,over:boolean>"
    begin = F.struct(F.lit("").alias("stack"), F.lit("value").alias("next"), F.lit(0).alias("n"), F.lit(0).alias("whole"), F.lit("").alias("open"), F.lit(False).alias("over")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        top, due, n = F.right(acc["stack"], F.lit(1)), acc["next"], acc["n"] + 1
        opens = t.isin("{", "[") & due.isin("value", "value or ]")
        closes = ((t == "]") & (top == "[") & due.isin("value or ]", "comma")) | ((t == "}") & (top == "{") & due.isin("name or }", "comma"))
        value = t.rlike(JSON_LITERAL) & due.isin("value", "value or ]")
        name = t.rlike(f"^{JSON_STRING}$") & due.isin("name", "name or }")
        comma = (t == ",") & (due == "comma")
        stack = F.when(opens, F.concat(acc["stack"], t)).when(closes, F.left(acc["stack"], F.length(acc["stack"]) - 1)).otherwise(acc["stack"])
        after = F.when(opens, F.when(t == "{", "name or }").otherwise("value or ]")).when(closes | value, "comma").when(name, "colon").when((t == ":") & (due == "colon"), "value").when(comma, F.when(top == "{", "name").otherwise("value"))
        safe = opens | closes | value
        row = F.struct(stack.alias("stack"), after.alias("next"), n.alias("n"), F.when(safe, n).otherwise(acc["whole"]).alias("whole"), F.when(safe, stack).otherwise(acc["open"]).alias("open"), (stack == "").alias("over"))
        stop = F.struct(acc["stack"].alias("stack"), due.alias("next"), acc["n"].alias("n"), acc["whole"].alias("whole"), acc["open"].alias("open"), F.lit(True).alias("over"))
        return F.when(acc["over"], acc).when(after.isNull(), stop.cast(state)).otherwise(row.cast(state))

    def told(parts: Column) -> Column:
        def closed(end: Column) -> Column:
            text = F.array_join(F.transform(F.slice(parts, 1, end["whole"]), lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(F.regexp_replace(t, r"[\n\r\t]", " "))), "")
            return F.concat(text, F.translate(F.reverse(end["open"]), "{[", "}]"))

        return let(F.aggregate(parts, begin, step), closed)

    whole = let(tokens, told)
    return let(whole, lambda v: F.when((v != "") & F.try_parse_json(v).isNotNull(), v))


def json_object(answer: Column) -> Column:
    """The first JSON object within an answer, as text, mended if it is cut off; null without."""
    return _json_value(answer, "{")


def json_array(answer: Column) -> Column:
    """The first JSON array within an answer, as text, mended if it is cut off; null without."""
    return _json_value(answer, "[")


def judge_score(answer: Column, name: str, other: float = 0.5) -> Column:
    """A number named in the JSON of an answer, held within 0 and 1; ``other`` where there is none."""
    value = F.get_json_object(json_object(answer), f"$.{name}").try_cast("double")
    return F.when(value.isNull(), other).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def encoded(text: Column) -> Column:
    """Percent-encoded, spaces too."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
