"""Word lists, constants and patterns that decide results."""

# All lists, numbers and patterns of this module.

STOPWORDS = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "what", "when", "where", "which", "who", "whose", "how", "does", "do", "did", "to", "of", "in", "on", "at", "for", "from", "with", "and", "or", "under", "user", "users", "s", "this", "that", "it", "as", "still", "treated", "should", "current", "latest", "now")
FUNCTION_WORDS = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "to", "of", "in", "on", "at", "for", "from", "with", "about", "by", "as", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their")
COREFERENCE = ("he", "she", "they", "them", "their", "his", "her", "hers", "it", "its", "this", "that", "these", "those", "former", "latter")
MODALITY = ("may", "might", "maybe", "perhaps", "possibly", "probably", "plan", "planned", "planning", "hope", "expect", "intend", "tentative", "could", "would", "should")
DISCOURSE_MARKERS = ("by the way", "actually", "anyway", "for context", "i mean", "one more thing", "quick question")
QUESTION_WORDS = ("what", "when", "where", "which", "who", "how", "does", "do", "did")

UPDATE_CUES = ("new", "updated", "replace", "changed", "change", "stopped", "current", "correction", "corrected", "wrong", "moved", "rescheduled", "revoked", "now")
CURRENT_QUERY_CUES = ("current", "now", "correct", "latest", "still", "applies", "should")
STRONG_UPDATE = ("updated", "replace", "replaced", "changed", "stopped", "correction", "corrected", "moved", "rescheduled", "revoked")
WEAK_UPDATE = ("new", "current", "now")
ADVERSARIAL = ("ignore", "query", "question", "discuss", "discussed", "keyword", "keywords", "stuffing", "decoy", "unrelated", "fake", "fabricated", "wrong", "answer", "instruction", "prompt")

REFERENCE_TIME = "2026-08-08T00:00:00+00:00"
SIMILARITY_CAP = 0.72
SIMILARITY_WEIGHT = 0.45
BASE = 0.20
RECENCY_WEIGHT = 0.10
UPDATE_BONUS = 0.18
WEAK_UPDATE_BONUS = 0.05
CURRENT_RECENCY = 0.04
ANCHOR_WEIGHT = 0.12
NOVEL_BONUS = 0.02
NOVEL_CAP = 3
ECHO_PENALTY = 0.28
ADVERSARIAL_PENALTY = 0.20
ECHO_COVERAGE = 0.75
ECHO_QUERY_ONLY = 0.80
ECHO_REPETITION = 0.15
ECHO_NOVEL = 1
BM25_K1 = 1.5
BM25_B = 0.75
WILSON_Z = 1.959963984540054

RELATIONS = {
    "phone": ("phone number", "phone", "telephone", "mobile"),
    "email": ("email address", "email", "e-mail", "mailbox"),
    "budget": ("budget",),
    "balance": ("balance",),
    "price": ("price", "cost"),
    "salary": ("salary", "wage"),
    "address": ("mailing address", "address"),
    "location": ("location", "room", "site", "shelf", "cabinet"),
    "date": ("date", "day"),
    "time": ("time", "hour"),
    "color": ("color", "colour"),
    "status": ("status", "state"),
    "owner": ("owner", "responsible person", "ownership"),
    "code": ("code", "passcode"),
    "pin": ("pin", "password"),
    "serial_number": ("serial number", "serial"),
    "version": ("version",),
    "provider": ("provider", "vendor", "supplier"),
    "preference": ("preference", "preferred", "favorite", "favourite"),
    "approval": ("approval", "reviewer"),
    "timezone": ("timezone", "time zone"),
    "registration_number": ("registration number", "registration", "plate"),
    "expiry": ("expiry", "expiration", "deadline", "due date"),
    "quantity": ("quantity", "count"),
    "type": ("type", "kind", "category"),
}
CURRENT = ("current", "latest", "now", "currently")
STALE = ("old", "previous", "prior", "stale", "historical", "formerly", "superseded", "obsolete", "archive", "before")
RESOLUTION = ("updated", "update", "replaced", "replace", "changed", "change", "corrected", "correction", "supersedes")
INFERENCE = ("probably", "likely", "guess", "assume", "assuming", "suggests", "implies", "maybe", "might", "possibly", "perhaps", "tentative")
GENERIC = ("what", "which", "who", "where", "when", "how", "is", "are", "was", "were", "does", "do", "did", "the", "a", "an", "of", "for", "to", "at", "on", "in", "and", "or", "with", "current", "latest", "now", "currently", "please", "tell", "me", "recorded", "known", "value", "values", "has", "have", "uses", "use", "used", "set", "confirmed", "final", "official", "this", "that", "fact", "note", "notes", "session", "meeting")

#: Discourse roles in the order in which they are tried: role, type, patterns (case-insensitive).
ROLE_PATTERNS = (
    ("NO_VALUE", "NO_VALUE_RECORDED", (r"\bno\s+(?:recorded|known|confirmed|current|available|explicit|direct)?\s*(?:answer|value|result|record)\b", r"\b(?:answer|value|result|record)\s+(?:is\s+)?(?:missing|absent|unknown|unavailable|not\s+present|not\s+recorded)\b", r"\bcontains?\s+no\s+(?:recorded|known|confirmed|available)?\s*(?:answer|value|result)\b", r"\bwithout\s+(?:a\s+)?(?:recorded|known|confirmed|available)?\s*(?:answer|value|result)\b", r"\banswer\s+not\s+present\b")),
    ("AGENDA", "AGENDA_ITEM", (r"\bagenda\b", r"\b(?:agenda|action)\s+item\b")),
    ("QUESTION", "QUESTION", (r"^\s*(?:what|which|who|where|when|how|does|do|did|is|are)\b", r"\bquestion\s+(?:about|regarding|for|repeated|restated)\b", r"\b(?:repeat|repeated|restate|restated|paraphrase|paraphrased)\s+(?:the\s+)?question\b", r"\?\s*$")),
    ("REVIEW", "REVIEW_TOPIC", (r"\breview\s+(?:of|about|regarding|topic)\b", r"\btopic\s+(?:only|for|about|regarding)\b", r"\b(?:discussion|discussion topic)\s+(?:of|about|regarding)\b")),
    ("UNRESOLVED", "UNRESOLVED", (r"\b(?:remains?|still)\s+(?:unresolved|unknown|pending|uncertain)\b", r"\b(?:unresolved|pending|uncertain)\s+(?:question|issue|value|answer)\b")),
    ("NEGATIVE", "NEGATED_VALUE", (r"\b(?:is|was|are|were)\s+not\b", r"\bdo\s+not\s+use\b", r"\b(?:wrong|incorrect|invalid)\s+(?:answer|value|code|number|email|phone|version|status|provider|owner)\b")),
    ("META", "META_DISCUSSION", (r"\b(?:discuss|discussed|discussion|mention|mentioned)\b", r"\b(?:prompt|instruction|keyword|query)\b")),
)
SUBJECT = "[A-Za-z][A-Za-z0-9_-]*"
VALUE = "[^,;.!?]+"

NAMESPACE = r"(?:candidate[-_ ]?v\d+|gate[-_ ]?[a-z]|protected(?:[-_ ]?(?:set|case|benchmark))?|confirmatory(?:[-_ ]?(?:set|case|benchmark))?|final[-_ ]?(?:gate|set|case|benchmark)|(?:entity|value|subject|relation)[-_]?\d+)"

#: Domains in order of priority, with their phrases.
DOMAINS = {
    "D3": ("appointment", "schedule", "calendar", "meeting", "reservation", "booking", "deadline"),
    "D4": ("subscription", "provider", "bank", "banking", "insurance", "bill", "billing", "payment", "renewal", "contract", "streaming service", "internet service", "utility", "phone plan"),
    "D5": ("travel", "trip", "flight", "airline", "airport", "hotel", "hostel", "train", "bus", "rental car", "vacation", "destination", "passport", "taxi", "rideshare", "uber"),
    "D6": ("device", "computer", "laptop", "phone", "smartphone", "tablet", "software", "application", "browser", "camera", "technology", "macbook", "iphone", "android"),
    "D7": ("project", "membership", "member of", "club", "organization", "community", "research project", "certification", "certificate", "volunteer", "initiative"),
    "D2": ("work", "job", "career", "employer", "employee", "office", "school", "education", "college", "university", "student", "teacher", "occupation", "degree"),
    "D8": ("routine", "daily", "weekly", "habit", "exercise", "workout", "sleep", "commute", "practice", "regularly", "every day", "every week"),
    "D1": ("prefer", "preference", "favorite", "favourite", "like", "dislike", "love", "hate", "hobby", "hobbies", "taste"),
}

#: Words of a preference's topic by domain, in the order of priority.
TOPICS = {
    "D3": ("schedule", "calendar", "appointment", "meeting", "reservation", "booking", "deadline"),
    "D4": ("subscription", "banking", "bank", "insurance", "billing", "payment", "streaming", "internet service", "utility", "phone plan", "financial service"),
    "D5": ("travel", "trip", "flight", "airline", "airport", "hotel", "vacation", "destination", "transportation", "rental car"),
    "D6": ("technology", "tech", "device", "computer", "laptop", "phone", "smartphone", "tablet", "software", "app", "camera", "browser"),
    "D7": ("project", "membership", "club", "organization", "community", "research", "certification", "volunteer", "initiative"),
    "D2": ("work", "job", "career", "employer", "occupation", "professional", "education", "school", "college", "university", "study"),
    "D8": ("routine", "exercise", "fitness", "workout", "sleep", "daily habit", "weekly habit", "practice", "wellness"),
    "D1": ("preference", "favorite", "favourite", "food", "music", "hobby", "hobbies", "sport", "sports", "style", "taste"),
}

#: Services of dialogues by domain; a service's name up to its first underscore.
SERVICES = {
    "D3": ("Calendar", "Events"),
    "D4": ("Banks", "Media", "Messaging", "Movies", "Music", "Payment", "Services"),
    "D5": ("Buses", "Flights", "Hotels", "RentalCars", "Ridesharing", "Trains", "Travel"),
}

#: Thresholds by stage: section, metric and bound; a name's end says whether it is the least or the most.
THRESHOLDS = {
    "ev_b": {
        "aggregate": {"MRR_min": 0.90, "R@1_min": 0.88, "R@3_min": 0.94, "R@5_min": 0.96, "answerable_recall_min": 0.94, "false_abstention_rate_max": 0.06, "false_retrieval_rate_max": 0.05, "abstention_accuracy_min": 0.93, "eligible_rank1_accuracy_min": 0.90},
        "frame": {"subject_binding_accuracy_min": 0.93, "relation_binding_accuracy_min": 0.93, "temporal_scope_accuracy_min": 0.92, "contradiction_handling_accuracy_min": 0.92, "discourse_contamination_rate_max": 0.03},
        "structural": {"N1": 0.92, "N2": 0.88, "N3": 0.85, "N4": 0.85, "N5": 0.85, "N6": 0.88, "N7": 0.88, "N8": 0.88, "N9": 0.85, "N10": 0.92, "N11": 0.82, "N12": 0.85},
    },
    "ev_c": {
        "aggregate": {"MRR_min": 0.88, "R@1_min": 0.85, "R@3_min": 0.92, "R@5_min": 0.95, "answerable_recall_min": 0.92, "false_abstention_rate_max": 0.08, "false_retrieval_rate_max": 0.06, "abstention_accuracy_min": 0.92, "eligible_rank1_accuracy_min": 0.88},
        "frame": {},
        "structural": {},
    },
}
CATASTROPHIC = 0.70
NEAR_UNIVERSAL = 0.98


def stem_of(word: str) -> str:
    """The stem of a list entry; functions.text.stem does the same to columns."""
    for end, least in (("ing", 4), ("ed", 3), ("s", 3)):
        if len(word) > least and word.endswith(end):
            return word[: -len(end)]
    return word


def stems_of(words: tuple[str, ...]) -> list[str]:
    return sorted({stem_of(w) for w in words})


def aliases() -> list[tuple[str, str]]:
    """(alias, relation), the longest alias first."""
    return sorted(((a, r) for r, names in RELATIONS.items() for a in names), key=lambda x: (-len(x[0]), x[0]))


def assertion_patterns() -> list[tuple[str, dict[str, int]]]:
    """Slot patterns in the order in which they are tried, with the number of each slot's group; no look-around."""
    rel = "|".join(a.replace("-", r"\-") for a, _ in aliases())
    lead, be, to = r"(?i)(?:^|:\s*|;\s*)", r"\s+(?:is|was|=|:)\s*", r"\s+(?:changed|updated|corrected|replaced)\s+(?:to|as)\s+"
    wide, narrow = r"(?:(current|latest|old|previous|prior|historical)\s+)?", r"(?:(current|latest)\s+)?"
    return [
        (rf"{lead}(?:the\s+)?{wide}({rel})\s+(?:for|of)\s+({SUBJECT}){be}({VALUE})", {"scope": 1, "relation": 2, "subject": 3, "value": 4}),
        (rf"{lead}({SUBJECT})(?:'s)?\s+{wide}({rel}){be}({VALUE})", {"subject": 1, "scope": 2, "relation": 3, "value": 4}),
        (rf"{lead}(?:the\s+)?{narrow}({rel})\s+(?:for|of)\s+({SUBJECT}){to}({VALUE})", {"scope": 1, "relation": 2, "subject": 3, "value": 4}),
        (rf"{lead}({SUBJECT})\s+({rel}){to}({VALUE})", {"subject": 1, "relation": 2, "value": 3}),
    ]
