"""Rule lexicons as data.

Every operator takes its rule list as an argument and defaults to a list here,
so a caller can swap in another lexicon without touching an operator.
"""

# --- fixed values -----------------------------------------------------------
# These phrases, patterns and tables decide results and are kept word for word.

REJECTION_PHRASES = [
    "we have decided",
    "we will not be moving forward",
    "not moving forward",
    "after careful consideration",
    "we've decided to pursue other candidates",
    "we have chosen to move forward with other candidates",
    "we won't be moving forward",
    "we regret to inform",
    "unfortunately",
    "we have filled the position",
    "the position has been filled",
    "we will keep your resume on file",
    "keep your resume on file",
    "we wish you the best",
    "thank you for your interest",
    "we are not able to offer you",
    "your application was not selected",
    "not selected for",
    "did not move forward",
    "no longer being considered",
]

APPLICATION_PHRASES = [
    "application received",
    "application submitted",
    "application confirmation",
    "we received your application",
    "thank you for applying",
    "thanks for applying",
    "your application for",
    "you applied to",
    "you have applied",
    "application for the role",
    "application for the position",
    "we've received your application",
    "successfully submitted",
    "your submission",
    "applied to",
    "confirming your application",
]

STRONG_REJECTION_SUBJECTS = [
    "unfortunately",
    "update on your application",
    "your application status",
    "decision regarding your application",
    "your candidacy",
]

STRONG_APPLICATION_SUBJECTS = [
    "application received",
    "application confirmation",
    "application submitted",
    "thank you for applying",
    "thanks for applying",
]

JOB_CONTEXT_TERMS = [
    "position", "role", "job", "application", "candidate", "candidacy",
    "hiring", "recruiter", "talent", "opportunity", "interview",
    "resume", "cv", "team", "engineering", "scientist", "analyst",
    "developer", "manager", "offer", "onboard",
]

HARD_REJECTION_PATTERNS = [
    "not moving forward",
    "will not be moving forward",
    "decided not to (move|proceed)",
    "chosen (to pursue|another) candidate",
    "not selected",
    "position has been filled",
    "not able to offer",
    "no longer (being )?considered",
    "did not move forward",
    "another candidate",
]

SOFT_REJECTION_PATTERNS = [
    "keep your (resume|cv) on file",
    "future opportunities",
    "stay in touch",
    "reach out (if|when) .{0,30} position",
    "we'll keep you in mind",
    "consider you for future",
]

ROLE_PATTERN = (
    r"(?:(?:Senior|Junior|Lead|Staff|Principal|Associate|Mid[- ]?Level)\s+)?"
    r"(?:Software\s+Engineer(?:ing)?|Machine\s+Learning\s+Engineer|ML\s+Engineer"
    r"|Data\s+(?:Scientist|Engineer|Analyst)|MLOps\s+Engineer|DevOps\s+Engineer"
    r"|Platform\s+Engineer|Backend\s+Engineer|Full[- ]?Stack\s+Engineer"
    r"|Research\s+(?:Scientist|Engineer)|Applied\s+Scientist"
    r"|Site\s+Reliability\s+Engineer|SRE)"
    r"(?:\s+(?:I{1,3}|IV|V|\d))?"
)

ROLE_FIRST_LETTERS = "sjlpamdbfr"

# (keyword, board); the first keyword found in the lower-cased sender wins.
JOB_BOARDS = [
    ("linkedin", "LinkedIn"),
    ("indeed", "Indeed"),
    ("glassdoor", "Glassdoor"),
    ("dice", "Dice"),
    ("ziprecruiter", "ZipRecruiter"),
    ("lever", "Lever"),
    ("greenhouse", "Greenhouse"),
    ("workday", "Workday"),
    ("icims", "iCIMS"),
    ("smartrecruiters", "SmartRecruiters"),
    ("myworkdayjobs", "Workday"),
]
# The ingest side of one mailbox kind knows only the first eight boards.
INGEST_JOB_BOARDS = JOB_BOARDS[:8]
DEFAULT_BOARD = "company_direct"

ENTITY_NOISE = [
    "linkedin", "indeed", "glassdoor", "greenhouse", "lever", "workday",
    "ziprecruiter", "dice", "the", "a", "an", "team", "company", "position",
    "role", "opportunity",
]

SENDER_DOMAIN_NOISE = [
    "gmail", "outlook", "yahoo", "hotmail", "greenhouse-mail", "lever",
    "workday", "myworkdayjobs",
]

REJECTION_LABELS = ["hard_rejection", "soft_rejection", "unknown"]
REJECTION_TYPES = REJECTION_LABELS + ["no_response"]
APPLICATION_STATUSES = ["applied", "interviewing", "offer", "rejected", "withdrawn"]
SOURCES = ["gmail", "outlook"]
CATEGORIES = ["rejection", "application", "unrelated"]
LABEL_THRESHOLD = 0.45

# Reading windows that a caller may ask for; every step reads whole texts by default.
GATE_BODY_CHARS = 1000
ENRICH_BODY_CHARS = 600
ENTITY_TEXT_CHARS = 500
CLASSIFIER_WORDS = 400
DISPLAY_SUBJECT_CHARS = 120

TOPIC_REJECTIONS = "raw.emails.rejections"
TOPIC_APPLICATIONS = "raw.emails.applications"
TOPIC_DLQ_REJECTIONS = "dlq.emails.rejections"
TOPIC_DLQ_APPLICATIONS = "dlq.emails.applications"

# (topic, partitions, replication, retention in days)
TOPIC_SPECS = [
    (TOPIC_REJECTIONS, 2, 1, 7),
    (TOPIC_APPLICATIONS, 2, 1, 7),
    (TOPIC_DLQ_REJECTIONS, 1, 1, 30),
    (TOPIC_DLQ_APPLICATIONS, 1, 1, 30),
]
MAX_MESSAGE_BYTES = 5_242_880
SCHEMA_VERSION = "1.0"
# --- end of fixed values ----------------------------------------------------
