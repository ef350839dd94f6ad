"""The rule library, the gap rules, the lenses and the enumerations, as data.

Fixed values: identifiers, categories, severities and patterns; results depend on them. The wording is this library's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CATEGORIES = (
    "COMPENSATION PROBATION NOTICE_PERIOD BOND_OR_EXIT_PENALTY NON_COMPETE NON_SOLICIT CONFIDENTIALITY IP_ASSIGNMENT TERMINATION "
    "BENEFITS WORKING_HOURS_LEAVE DISPUTE_RESOLUTION DOCUMENT_RETENTION MOONLIGHTING GENERAL OTHER"
).split()
RISKS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

COMPETE = r"(shall not|will not|must not|agrees not to|refrain from|prohibited from|restrained from)[^.]{0,250}(compet|similar business|rival|engage in any business)"
AFTER = (
    r"(after|following|upon|post)[- ]?(the )?(termination|cessation|expiry|resignation|leaving|separation|end of (the )?employment)|post[- ]employment"
    r"|(for a period of|for)[^.]{0,40}(from|after) (the )?(date of )?(termination|resignation|leaving|separation|last working day)"
)
DURING = r"(during|throughout|for the (term|period|duration) of)[^.]{0,40}(employment|engagement|service|this agreement)|while (employed|in the employment|working)"
SALARY_PARTS = (
    r"\bbasic\b", r"house rent allowance|\bhra\b", r"special allowance", r"\bctc\b|cost to company", r"gross (salary|pay)", r"provident fund|\bpf\b",
    r"gratuity", r"conveyance|transport allowance", r"medical allowance", r"variable pay|performance (pay|bonus)",
)
ORIGINALS = r"original (certificate|certificates|document|documents|mark ?sheet|mark ?sheets|degree|degrees|testimonial)"
KEEPING = r"retain|deposit|submit|surrender|keep|hold|custody|safe custody"
#: A promise not to keep originals, with no time limit behind it in its sentence.
NO_KEEPING = r"(shall|will|may|does) not (retain|keep|hold|take)"
TIME_LIMIT = r"\b(beyond|after|longer than|more than|until)\b"
GIVEN_BACK = r"not be (retained|kept|held)|verified and returned|returned (to you |to the employee )?(immediately|forthwith|on the same day|after verification)"


@dataclass(frozen=True)
class Rule:
    """Fires on clauses of ``applies`` (all if empty) whose text has every pattern of ``has`` and none of ``lacks``;
    ``special`` names what the engine adds: bond, asymmetric, long, salary, keeping."""

    id: str
    applies: tuple[str, ...]
    severity: str
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    special: str = ""
    title: str = ""
    questions: tuple[str, ...] = field(default=())


RULES = (
    Rule("IN-EMP-NONCOMPETE-POST", ("NON_COMPETE",), "HIGH", (COMPETE, AFTER), title="Competing is restricted after you leave", questions=("How long does the restriction last once I have left?", "Could it be limited to confidential information?")),
    Rule("IN-EMP-NONCOMPETE-DURING", ("NON_COMPETE", "MOONLIGHTING"), "INFO", (DURING,), (AFTER,), title="Exclusive work while employed", questions=("Are side projects outside the business allowed?",)),
    Rule("IN-EMP-BOND", ("BOND_OR_EXIT_PENALTY",), "MEDIUM", (r"bond|service agreement|liquidated damages|minimum (period of )?service|minimum service|training cost|pay the company|reimburse the company|recover|forfeit",), special="bond", title="Payment for leaving early", questions=("Does the amount fall with every month served?", "Which costs does the amount cover?")),
    Rule("IN-EMP-NOTICE-ASYMMETRIC", ("NOTICE_PERIOD", "TERMINATION"), "MEDIUM", special="asymmetric", title="Your notice is the longer one", questions=("Can both sides give the same notice?",)),
    Rule("IN-EMP-NOTICE-LONG", ("NOTICE_PERIOD",), "MEDIUM", special="long", title="Long notice", questions=("Can notice be bought out?",)),
    Rule("IN-EMP-DOC-RETENTION", (), "HIGH", (ORIGINALS, KEEPING), (GIVEN_BACK,), special="keeping", title="Original documents are kept", questions=("Are attested copies enough?",)),
    Rule("IN-EMP-NONSOLICIT", ("NON_SOLICIT",), "MEDIUM", (r"solicit|entice|induce|poach|approach[^.]{0,40}(client|customer|employee|personnel)",), title="Contacting clients or staff is restricted", questions=("Which clients are covered?",)),
    Rule("IN-EMP-CONFIDENTIALITY", ("CONFIDENTIALITY",), "INFO", (r"confidential|proprietary information|trade secret|non[- ]disclosure",), title="Secrecy", questions=("How long does secrecy last?",)),
    Rule("IN-EMP-IP-BROAD", ("IP_ASSIGNMENT",), "MEDIUM", (r"(intellectual property|copyright|invention|work product|deliverable)", r"(outside (of )?(working|office|business) hours|whether or not|at any time|during or after|any time during|unrelated to)"), title="Wide claim on what you make", questions=("Can own projects be excluded?",)),
    Rule("IN-EMP-TERMINATION-NO-NOTICE", ("TERMINATION",), "MEDIUM", (r"without (any )?(prior )?(notice|reason|cause)|at (its|the company's|their) sole discretion|with immediate effect",), (r"misconduct|fraud|dishonesty|breach of|criminal|insubordination|negligence",), title="Dismissal without notice", questions=("What is paid instead of notice?",)),
    Rule("IN-EMP-CLAWBACK", ("COMPENSATION", "BOND_OR_EXIT_PENALTY", "BENEFITS"), "MEDIUM", (r"joining bonus|sign[- ]?on bonus|signing bonus|relocation|retention bonus|joining incentive", r"repay|repaid|refund|recover|claw ?back|return the|deduct"), title="Bonus to be paid back", questions=("Does the repayment fall with time served?",)),
    Rule("IN-EMP-UNILATERAL-CHANGE", ("GENERAL", "COMPENSATION", "BENEFITS", "OTHER"), "MEDIUM", (r"(may|reserves the right to|shall be entitled to) (amend|modify|change|revise|alter|withdraw)", r"(terms|policies|policy|compensation|salary|benefits|this agreement|conditions)", r"(sole discretion|without notice|without prior notice|from time to time|at its discretion)"), title="Terms can change one-sidedly", questions=("Which changes need my consent?",)),
    Rule("IN-EMP-PROBATION-EXTEND", ("PROBATION",), "MEDIUM", (r"probation", r"(may be|can be|shall be|liable to be) extended|extend(ed)? at the (sole )?discretion"), (r"maximum|not exceed|no longer than|no more than|not more than|at most|up to a total|extended (only )?once|one further period",), title="Probation without an end", questions=("How long can probation last?",)),
    Rule("IN-EMP-WAGES-50", ("COMPENSATION",), "INFO", special="salary", title="Make-up of the salary", questions=("What is paid out each month?",)),
    Rule("IN-EMP-GRATUITY-FTE", ("BENEFITS", "GENERAL", "OTHER"), "INFO", (r"fixed[- ]term|contract (period|basis)|contractual employment|for a term of \d+ (month|year)",), title="Gratuity in fixed-term work", questions=("Is the post fixed-term?",)),
    Rule("IN-EMP-JURISDICTION", ("DISPUTE_RESOLUTION",), "INFO", (r"arbitration|arbitrator|jurisdiction|courts? (at|of|in)|tribunal",), title="Place of disputes", questions=("Where would a dispute be heard?",)),
)


@dataclass(frozen=True)
class Gap:
    """A document has a gap if no clause matches ``pattern`` (or, for notice, holds a notice period)."""

    id: str
    label: str
    pattern: str
    question: str


GAPS = (
    Gap("IN-EMP-MISSING-NOTICE", "Notice", r"notice period", "How much notice does each side give?"),
    Gap("IN-EMP-MISSING-SALARY", "Salary", r"\bctc\b|cost to company|salary|remuneration|compensation of|per annum", "What is the full salary?"),
    Gap("IN-EMP-MISSING-ROLE", "Role", r"designation|job title|position of|role of|reporting to|report to|duties|(appointed|employed|engaged|join|joins|joining) as (an? )?\w", "What is the role?"),
    Gap("IN-EMP-MISSING-LOCATION", "Location", r"place of (work|posting)|work location|based (at|in)|transfer|relocat", "Where is the work?"),
    Gap("IN-EMP-MISSING-LEAVE", "Leave", r"(annual|casual|sick|earned|privilege|paid|maternity|paternity) leave|leave (entitlement|balance|of \d)|\d+ (days?|weeks?) of (paid )?leave|leave per (year|annum)|vacation (days|entitlement)", "How much leave is there?"),
    Gap("IN-EMP-MISSING-PROBATION", "Probation", r"probation|confirmation of employment", "Is there a probation?"),
)

LENSES = {
    "QUIT_EARLY": (("NOTICE_PERIOD", "BOND_OR_EXIT_PENALTY"), ("TERMINATION", "DOCUMENT_RETENTION", "COMPENSATION"), ("ask.q.noticePeriod", "ask.q.bondCost", "ask.q.noticeBuyout")),
    "FUTURE_JOBS": (("NON_COMPETE", "NON_SOLICIT", "CONFIDENTIALITY"), ("IP_ASSIGNMENT", "MOONLIGHTING"), ("ask.q.joinCompetitor", "ask.q.sideProjects", "ask.q.confidentialAfter")),
    "SALARY": (("COMPENSATION", "BENEFITS"), ("WORKING_HOURS_LEAVE", "BOND_OR_EXIT_PENALTY"), ("ask.q.inHandSalary", "ask.q.variablePay", "ask.q.deductions")),
    "GETTING_FIRED": (("TERMINATION", "PROBATION"), ("NOTICE_PERIOD", "DISPUTE_RESOLUTION"), ("ask.q.terminationNotice", "ask.q.probationRules", "ask.q.disputeForum")),
    "EVERYTHING": ((), (), ("ask.q.biggestRisk", "ask.q.missingInfo", "ask.q.negotiate")),
}

# What a summary takes from a letter. (pattern, group, case ignored); the first clause that matches.
EMPLOYER_NAME = r"[A-Z][A-Za-z]+ Technologies Private Limited"
ROLE_NAME = r"position of ([A-Z][A-Za-z ]+?)(?: (?:with|at|in)\b|[,.])"
START_DATE = r"(?:effective from|joining on|join on|date of joining is) (\d{1,2} [A-Z][a-z]+ \d{4})"
NOTICE_LENGTH = r"(?:ninety|sixty|thirty|\d{1,3}) \(?\d{0,3}\)? ?days"
PROBATION_LENGTH = r"probation for a period of ([^.,]{3,40}?)(?: from| starting|[.,])"
BOND_TOPIC = r"liquidated damages|training bond|service bond|minimum period"
BOND_AMOUNT = r"Rs\. ?[\d,]+"
SUMMARY = {
    "employer": (EMPLOYER_NAME, 0, False), "role": (ROLE_NAME, 1, False), "start_date": (START_DATE, 1, True), "notice_period": (NOTICE_LENGTH, 0, True),
    "probation": (PROBATION_LENGTH, 1, True),
}
DOCUMENT_TYPE = "Letter of appointment"

# Glossary terms and the forms that they appear as, the earlier term winning where forms overlap.
GLOSSARY = {
    "liquidatedDamages": ("liquidated damages",), "arbitration": ("arbitration", "arbitrator"), "noticePeriod": ("notice period", "नोटिस पीरियड"), "ctc": ("cost to company", "CTC"),
    "indemnity": ("indemnify", "indemnity"), "probation": ("probation", "प्रोबेशन"), "nonCompete": ("non-compete", "non compete", "noncompete"), "gratuity": ("gratuity", "ग्रेच्युटी"),
    "providentFund": ("provident fund", "PF"), "jurisdiction": ("jurisdiction",),
}
